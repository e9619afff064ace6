"""Parallel arbitration equals the sequential fold, whatever is shared."""

from __future__ import annotations

import random
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tidemark import DEFAULT
from tidemark.operators import arbiter, decide

SEC = 1_000_000
ROW = (
    "run_id string, session bigint, symbol string, ts_us bigint, seq bigint, pref bigint, direction int, level_price double, "
    "is_trend boolean, vol_ratio_prev double, score double, penalty double, comp_active boolean, bucket int, prob double, "
    "efficacy_prob double, resolution string, resolution_us bigint, label boolean, was_late boolean, ready boolean, due_us bigint"
)
CALM = replace(
    DEFAULT, max_alerts_hour_total=10**6, max_alerts_burst=10**6, min_labels=10**6, max_alerts_symbol_day=7,
    cooldown_failed_s=20, cooldown_confirmed_s=50, cooldown_suppressed_s=30, min_gap_same_symbol_s=15, trend_max_per_day=2,
)


def tape(spark, seed, symbols=6, n=250, sessions=(1, 2), runs=("r",), span=1500):
    """Random candidates: few instants and levels, so that ties and re-arming are common."""
    rng = random.Random(seed)
    rows = []
    for run in runs:
        for day in sessions:
            for s in range(symbols):
                for k in range(n * (5 if s == 0 else 1)):
                    ts = day * 10**10 + rng.randrange(span) * SEC
                    trend = rng.random() < 0.1
                    state = rng.choice(["CONFIRMED", "FAILED", "FAILED"])
                    end = ts + rng.randrange(5, 80) * SEC if state and rng.random() < 0.97 else None
                    rows.append((
                        run, day, f"S{s}", ts, k, rng.randrange(3), rng.choice([1, -1]), rng.choice([100.0, 100.05, 101.0, 104.0, 0.0]),
                        trend, rng.choice([1.0, 2.0, 3.0]), rng.choice([0.2, 0.5, 0.56, 0.6, 0.9]), rng.choice([0.0, 0.03]),
                        rng.random() < 0.3, rng.randrange(3), rng.choice([None, 0.1, 0.9]), rng.choice([None, 0.1, 0.9]),
                        state if end else None, end, rng.random() < 0.4, rng.random() < 0.2, rng.choice([True, True, False, None]), ts + 300 * SEC,
                    ))
    return spark.createDataFrame(rows, ROW)


def outcome(df):
    return Counter((r.run_id, r.session, r.symbol, r.ts_us, r.seq, r.pref, r.verdict, round(r.vol_mult, 9), r.gate_version) for r in df.collect())


TIGHT = {
    "calm": {},
    "budget of an hour": {"max_alerts_hour_total": 9, "hour_window_s": 400.0},
    "budget of a burst": {"max_alerts_burst": 1, "burst_window_s": 20.0},
    "no budget": {"max_alerts_hour_total": 0},
    "labels": {"min_labels": 8, "revert_window": 8},
    "few labels": {"min_labels": 40},
}


@pytest.mark.parametrize("name", TIGHT)
@pytest.mark.parametrize("carry", [False, True])
def test_equals_the_fold(spark, name, carry):
    p = replace(CALM, **TIGHT[name])
    rows = tape(spark, len(name)).cache()
    want = outcome(arbiter.arbitrate(rows, p, carry=carry))
    got = outcome(decide.arbitrate(rows, p, carry=carry))
    assert got == want and sum(want.values()) > 50
    few = {k: n for k, n in want.items() if k[6] in ("SIGNAL", "SUPPRESSED")}
    assert outcome(decide.arbitrate(rows, p, carry=carry, verdicts=False)) == few
    tied = decide.entangled(decide.accepted(rows, p), p, carry).count()
    # so few outcomes that only those of several sessions together would count
    assert (tied == 0) == (name == "calm" or (name == "few labels" and not carry))
    if name == "calm":
        kinds = {k[6] for k in want}
        assert {"SIGNAL", "SUPPRESSED", "trend_day_cap", "symbol_day_cap", "score", "fake_start", "volume_accel"} <= kinds
    if "budget" in name:
        assert any(k[6] == "global_hour_cap" for k in want)
    rows.unpersist()


def test_only_entangled_sessions_are_folded(spark):
    """A busy session meets its budget, a quiet one of the same run does not."""
    p = replace(CALM, max_alerts_burst=2, burst_window_s=30.0)
    rows = tape(spark, 5, sessions=(1,), span=300).union(tape(spark, 6, symbols=1, n=30, sessions=(2,), span=20_000)).cache()
    tied = {r.session for r in decide.entangled(decide.accepted(rows, p), p).collect()}
    assert tied == {1}
    assert outcome(decide.arbitrate(rows, p)) == outcome(arbiter.arbitrate(rows, p))


def test_batches_and_empty_input(spark):
    rows = tape(spark, 9, symbols=3, n=60).cache()
    want = outcome(arbiter.arbitrate(rows, CALM))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "7")
    try:
        assert outcome(decide.arbitrate(rows, CALM)) == want
    finally:
        spark.conf.unset(key)
    assert decide.arbitrate(rows.limit(0), CALM).count() == 0
    none = replace(CALM, max_alerts_symbol_day=0)
    assert outcome(decide.arbitrate(rows, none)) == outcome(arbiter.arbitrate(rows, none))


def test_dispositions_name_every_candidate(spark):
    rows, p = tape(spark, 12, symbols=4).cache(), replace(CALM, min_gap_same_symbol_s=70)
    told = decide.dispositions(rows, decide.accepted(rows, p), p)
    assert told.count() == rows.count() and told.filter("disposition is null").count() == 0
    loud = Counter(r.disposition for r in told.filter(~F.col("disposition").isin(*decide.SILENT)).collect())
    assert loud == Counter(k[6] for k in outcome(arbiter.arbitrate(rows, p)).elements())
    quiet = {r.disposition for r in told.select("disposition").distinct().collect()} & set(decide.SILENT)
    assert quiet == set(decide.SILENT)
