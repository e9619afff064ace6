"""Steps whose work must grow no faster than their input, against plain Python."""

from __future__ import annotations

import random
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import resolve, snapshot
from tidemark.profile import DEFAULT
from tidemark.sources.views import EVENTS_PROFILE as P

U = P.unit_us


def dense_prints(n: int):
    """Prints at chunk borders, at equal instants, in two symbols and sessions, some without flow."""
    rng = random.Random(7)
    span = 4 * P.macro_us
    return [
        (rng.choice("AB"), rng.choice([1, 2]), rng.choice([rng.randrange(span), rng.randrange(8) * P.macro_us // 2]),
         i, rng.choice([True, True, False]), rng.choice([-1, 0, 1]), rng.randrange(1, 50))
        for i in range(n)
    ]


COLS = "symbol string, session long, ts_us long, seq long, flow_eligible boolean, side int, size long"


def slow_persistence(rows):
    back, near, out = P.us(P.persist_window_s), P.us(P.persist_short_s), {}
    for sym, ses, ts, seq, *_ in rows:
        seen = [r for r in rows if r[:2] == (sym, ses) and r[4] and ts - back <= r[2] <= ts]
        values = [sum(r[2] >= ts - near for r in seen)]
        for sign in (1, -1):
            own = [r for r in seen if r[5] == sign]
            at, sizes = [r[2] for r in own], [r[6] for r in own]
            values += [len(own), (max(at) - min(at)) / U if len(own) > 1 else 0.0, max(sizes) / sum(sizes) if own else 1.0]
        out[seq] = values
    return out


def test_persistence_does_not_reread_its_window(spark):
    rows = dense_prints(700)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        out = snapshot.with_persistence(spark.createDataFrame(rows, COLS).repartition(3), P)
        # a sliding frame is folded anew for every row, which is quadratic in the tape's density
        assert "RangeFrame" not in out._jdf.queryExecution().toString()
        names = ("n2s", "persist_up", "span_up", "dom_up", "persist_dn", "span_dn", "dom_dn")
        have = {r.seq: [r[c] for c in names] for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert have == slow_persistence(rows)


@pytest.mark.parametrize("name", ["signals", "signals_gated"])
def test_signals_keep_to_their_statement_where_labels_gather(spark, monkeypatch, name):
    """Every label would wake the adaptive multipliers; the statements hold them at one."""
    import __spark_entry__ as entry
    import oracle
    from tidemark.catalog import base, signals

    sf = "/root/testdata/sf0.01"
    t = base.tape(spark, sf)
    monkeypatch.setattr(t, "profile", replace(t.profile, min_labels=1))
    monkeypatch.setattr(signals, "_FINISHED", {})
    ok, message, _ = oracle.compare(spark, oracle.duck(sf), name, entry.queries()[name], entry.oracle_sql()[name], sf)
    assert ok, message


def test_candidates_are_not_written_whole(spark):
    """What outgrows the tape is read where it is needed; only promising candidates are written."""
    from tidemark.catalog import base

    t = base.tape(spark, "/root/testdata/sf0.001")
    read = t.evaluated.inputFiles()
    assert read and not any("/evaluated-" in f for f in read)
    assert t.promising.count() < t.evaluated.count()
    assert t.promising.filter("gate_reason is null").count() == t.evaluated.filter("gate_reason is null").count()


def test_what_no_level_changes_is_not_worked_out_per_candidate(spark):
    """Gates of a print are read with it, and prints that fail on their own meet no reclaims."""
    from tidemark.catalog import base

    t = base.tape(spark, "/root/testdata/sf0.001")
    assert any("/ways-" in f for f in t.evaluated.select("gate_reason").inputFiles())
    plan = t.evaluated.select("seq", "gate_reason")._jdf.queryExecution().optimizedPlan().toString()
    assert "vel15" not in plan and "persist_trades" not in plan
    # one row a print and direction, however many levels it meets
    prints = t.leveled.filter(snapshot.may_evaluate()).count()
    assert t.ways.count() == 2 * prints < t.evaluated.count() + 2 * prints
    some = t.judged(t.ways.filter("way_reason is null")).filter("gate_reason is null").count()
    assert some == t.evaluated.filter("gate_reason is null").count()


def test_fresh_reclaims_meet_prints_in_slices(spark):
    """Every fresh reclaim once, also where slices end, and none of the other direction."""
    from tidemark.operators import sweeps

    span = 4 * P.us(P.reclaim_age_s)
    prints = spark.range(0, span, span // 400).selectExpr("'A' symbol", "1L session", "id ts_us", "id seq")
    again = prints.selectExpr("symbol", "session", "ts_us", "seq", "1.0D level", "0 kind", "1 direction")
    out = sweeps.active_reclaims(prints, again, P)
    age = P.us(P.reclaim_age_s)
    at = [r.ts_us for r in prints.collect()]
    assert out.count() == sum(a <= b <= a + age for a in at for b in at)
    other = sweeps.active_reclaims(prints.selectExpr("*", "-1 direction"), again, P)
    assert other.count() == 0


@pytest.mark.parametrize("digits", [4, 6])
def test_quick_rounding_is_round(spark, digits):
    from pyspark.sql import functions as F

    from tidemark.functions.expr import r, r_many

    rng = random.Random(3)
    rows = [(rng.uniform(-1, 1) * 10 ** rng.uniform(-9, 14),) for _ in range(3000)]
    rows += [(round(rng.uniform(-9, 9), digits) + s * 5 / 10 ** (digits + 1),) for _ in range(3000) for s in (1, -1)]
    rows += [(v,) for v in (0.0, -0.0, -1e-12, float("nan"), float("inf"), -float("inf"), 1e300, None)]
    x = F.col("x")
    both = spark.createDataFrame(rows, "x double").select(r(x, digits).alias("a"), r_many(x, digits).alias("b"))
    assert both.filter("cast(a as string) is distinct from cast(b as string)").count() == 0


def test_candidates_are_never_broadcast(spark, tmp_path):
    """Small files of candidates hold many rows, and each comes once for every chunk it touches."""
    kinds = "symbol string, session bigint, ts_us bigint, seq bigint, pref bigint, direction int, price double, level_price double, invalidation double"
    spark.createDataFrame([("X", 1, 0, 0, 0, 1, 1.0, 1.0, 0.9)], kinds).write.parquet(f"{tmp_path}/cands")
    cands = spark.read.parquet(f"{tmp_path}/cands")
    c = F.col
    bars = spark.range(10**9).select(
        F.lit("X").alias("symbol"), F.lit(1).cast("long").alias("session"), (c("id") * 10**6).alias("b_us"),
        c("id").cast("double").alias("high"), c("id").cast("double").alias("low"))
    for out in (resolve.watched_buckets(cands, bars, DEFAULT), resolve.label_outcomes(cands, bars, DEFAULT)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan, plan


def test_verdicts_do_not_depend_on_blocks(spark, monkeypatch):
    """Many prints of one bucket against many candidates: the same verdicts in blocks of any size,
    and those of a loop over the prints."""
    p = DEFAULT
    rng = np.random.default_rng(3)
    n, m = 60, 40
    ts = np.sort(rng.integers(0, 3 * p.unit_us, m))
    ts[5:12] = ts[5]  # of one instant, in the order of their ids
    f = {c: rng.normal(0, 1, m) for c in ("imb5", "slope", "o_mkt", "o_fear")}
    seen = pa.table({"b_us": ts // p.unit_us * p.unit_us, "o_ts": ts, "o_prio": np.ones(m, int), "o_seq": np.arange(m),
                     "o_price": 100 + rng.normal(0, 0.05, m), "share5": rng.random(m), "vol5": np.ones(m), "o_vol": np.ones(m), **f})
    at = rng.integers(0, m, n)
    d = rng.choice([-1, 1], n)
    later = rng.random(n) < 0.3
    pairs = pa.table({"symbol": ["X"] * n, "session": np.ones(n, int), "ts_us": ts[at], "seq": at, "pref": np.arange(n),
                      "direction": d.astype(np.int32), "price": 100.0 + d * 0.01, "level_price": np.full(n, 100.0), "invalidation": 100 - d * 0.08,
                      "in_open": rng.random(n) < 0.5, "best": pa.array(np.where(later, d * 100.02, 0), mask=~later),
                      "b_us": (ts[at] // p.unit_us + later) * p.unit_us})
    whole = resolve._meet(p)(pairs, seen)
    monkeypatch.setattr(resolve, "PAIRS", 3)
    assert resolve._meet(p)(pairs, seen).equals(whole)
    assert len(set(whole.column("rule").to_pylist())) > 2
    for r, x in zip(whole.to_pylist(), pairs.to_pylist(), strict=True):
        best = max([x["price"] * x["direction"]] + ([x["best"]] if x["best"] is not None else []))
        first = None
        for o in seen.to_pylist():
            if o["b_us"] == x["b_us"] and (o["o_ts"], o["o_seq"]) > (x["ts_us"], x["seq"]):
                best = max(best, o["o_price"] * x["direction"])
                if first is None and (o["o_price"] - x["invalidation"]) * x["direction"] < 0:
                    first = o["o_ts"], o["o_price"]
        assert r["best"] == best
        if r["rule"] == 1:
            assert (r["o_ts"], r["o_price"]) == first
        elif first is not None:
            assert r["rule"] and r["o_ts"] <= first[0]
