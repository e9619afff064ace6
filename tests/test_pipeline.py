"""Whole-plan properties on a small two-symbol tape with one-second units."""

from __future__ import annotations

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tests.fixtures import QUOTE, RAW, SEC, T0
from tidemark import DEFAULT
from tidemark.operators import arbiter, resolve
from tidemark.operators import bars as B
from tidemark.plans import arbitration as A
from tidemark.plans.pipeline import Tape
from tidemark.sources import wire
from tidemark.streaming import live, verdicts

OPEN = T0 + 120 * SEC
LOOSE = replace(
    DEFAULT,
    vel_min_bps_s=0.1, vel15_max_bps_s=50.0, range_exp_max=50.0, vol_accel_min=0.5,
    vol_base_min=0.0, imb_min=-1.0, imb15_min=-1.0, persist_min_trades=1,
    persist_min_span_s=0.0, min_trades_2s=1, single_print_max_frac=1.0, score_min=0.31,
    outcome_window_s=60, cooldown_failed_s=20.0, cooldown_confirmed_s=40.0,
    min_gap_same_symbol_s=5.0, max_alerts_symbol_day=6, burst_window_s=10.0, max_alerts_burst=1,
    min_labels=3, revert_window=8,
)


def make(spark, seed=1, seconds=1500, symbols=("AAA", "BBB")):
    rng = random.Random(seed)
    prints, quotes, seq = [], [], 0
    for s in symbols:
        px = 100.0
        for t in range(seconds):
            drift = 0.02 if (t // 90) % 3 == 1 else (-0.015 if (t // 90) % 3 == 2 else 0.0)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                px = max(90.0, px + drift + rng.gauss(0, 0.015))
                at = T0 + t * SEC + rng.randrange(SEC)
                cond = rng.choice([["@"], ["@"], ["@"], ["@", "F"], ["@", "I"], ["W"]])
                prints.append((s, 1, at, seq, round(px, 2), rng.randint(1, 400), cond, at, OPEN,
                               T0 + 10**10))
                seq += 1
                if rng.random() < 0.5:
                    quotes.append((s, 1, at + 1, seq, round(px - 0.01, 2), rng.randint(1, 9),
                                   round(px + 0.01, 2), rng.randint(1, 9)))
                    seq += 1
    sessions = spark.createDataFrame(
        [(1, OPEN, T0 + 10**10)], "session bigint, open_us bigint, close_us bigint"
    )
    return spark.createDataFrame(prints, RAW), spark.createDataFrame(quotes, QUOTE), sessions


@pytest.fixture(scope="module")
def tape(spark):
    p, q, s = make(spark)
    return Tape(p, q, s, LOOSE, "AAA", "BBB")


def test_pipeline_finds_candidates(tape):
    assert tape.passing.count() > 20
    assert tape.reclaims.count() > 0
    assert tape.resolutions.count() > 10


def test_no_lookahead(spark, tape):
    """Cutting the tape changes nothing that was known before the cut."""
    cut = T0 + 900 * SEC
    p, q, s = make(spark)
    short = Tape(
        p.filter(F.col("ts_us") < cut), q.filter(F.col("ts_us") < cut), s, LOOSE, "AAA", "BBB"
    )
    cols = ["seq", "pref", "gate_reason", F.round("score", 9).alias("score"), "invalidation"]
    full = tape.evaluated.filter(F.col("ts_us") < cut).select(*cols)
    part = short.evaluated.select(*cols)
    assert part.count() > 100
    assert full.exceptAll(part).count() == 0 and part.exceptAll(full).count() == 0


def _slow_fold(p, rows, scope):
    """Sequential restatement of the arbitration rules over plain tuples."""
    state, alerts, out = {}, {}, []
    for r in sorted(rows, key=lambda r: (r.ts_us, r.symbol, r.seq, r.pref)):
        s = state.setdefault(r.symbol, dict(free=-1, last=None, n=0, trends=0, prev=None))
        book = alerts.setdefault(r.symbol if scope == "symbol" else "all", [])
        if r.ts_us < s["free"]:
            continue
        if s["prev"] and s["prev"][1] == r.direction:
            if abs(r.level_price - s["prev"][0]) / s["prev"][0] * 1e4 < p.re_arm_bps:
                continue
        if r.is_trend:
            if s["trends"] >= p.trend_max_per_day:
                continue
        else:
            need = max(0.30, p.score_min * (p.compression_relax if r.comp_active else 1.0))
            if r.vol_ratio_prev < p.vol_accel_min or r.score - r.penalty < need:
                continue
        if s["n"] >= p.max_alerts_symbol_day:
            continue
        if s["last"] is not None and r.ts_us - s["last"] < p.us(p.min_gap_same_symbol_s):
            continue
        hour = [t for t in book if r.ts_us - t <= p.us(p.hour_window_s)]
        burst = [t for t in book if r.ts_us - t <= p.us(p.burst_window_s)]
        if len(hour) >= p.max_alerts_hour_total or len(burst) >= p.max_alerts_burst:
            continue
        s.update(last=r.ts_us, prev=(r.level_price, r.direction), n=s["n"] + 1)
        s["trends"] += bool(r.is_trend)
        book.append(r.ts_us)
        wait = p.cooldown_confirmed_s if r.resolution == "CONFIRMED" else p.cooldown_failed_s
        s["free"] = float("inf") if r.resolution_us is None else r.resolution_us + p.us(wait)
        out.append((r.symbol, r.ts_us, r.seq, r.pref))
    return out


@pytest.mark.parametrize("scope", ["session", "symbol"])
def test_arbitration_matches_slow_fold(tape, scope):
    rows = tape.stage(A.finished(tape), "finished")
    got = A.signals(tape, rows, scope=scope, adapt=False)
    have = sorted((r.symbol, r.ts_us, r.seq, r.pref) for r in got.collect())
    want = sorted(_slow_fold(LOOSE, rows.collect(), scope))
    assert have == want and len(want) >= 4
    ids = [r.signal_id for r in got.collect()]
    assert all(i.rsplit("-", 1)[1] in "UD" for i in ids)


def test_busy_time_hides_rejections(tape):
    rows = tape.stage(A.finished(tape), "finished")
    sigs = A.signals(tape, rows)
    left = A.effective_rejections(tape, rows, sigs).agg(F.sum("rejections")).first()[0]
    every = tape.evaluated.filter("gate_reason <> 'untriggered'").count()
    assert 0 < left < every


def test_gate_reverts_and_relearns():
    g = arbiter.GateState(replace(DEFAULT, min_labels=10, revert_window=10))
    for _ in range(10):
        g.learn(("X", 0), True, False)
    assert g.active and g.baseline == 1.0 and g.multiplier(("X", 0)) < 1.0
    reverted = [g.learn(("X", 0), False, False) for _ in range(3)]
    assert reverted == [False, True, False] and g.reverted and g.version == 2
    assert g.multiplier(("X", 0)) == 1.0
    for _ in range(10):
        g.learn(("X", 0), True, False)
    assert not g.reverted


LABEL = (
    "symbol string, session bigint, ts_us bigint, seq bigint, pref bigint, direction int, "
    "price double, level_price double, invalidation double"
)


def _label(spark, path, direction=1, alert=100.02, inv=99.9):
    bars = [("X", 1, T0 + i * SEC, h, lo) for i, (h, lo) in enumerate(path)]
    bars = spark.createDataFrame(
        bars, "symbol string, session bigint, b_us bigint, high double, low double"
    )
    cand = spark.createDataFrame([("X", 1, T0, 0, 0, direction, alert, 100.0, inv)], LABEL)
    p = replace(DEFAULT, outcome_window_s=120)
    return resolve.label_outcomes(cand, bars, p).first()


def test_deadlines_in_silence(spark):
    """Before a hole of twenty minutes, and before a symbol's last print, every candidate whose session
    outlives its deadline has a verdict, the one it would get with a bar for every second."""
    p, q, s = make(spark, seed=2, seconds=900)
    hole = (F.col("ts_us") < T0 + 400 * SEC) | (F.col("ts_us") >= T0 + 1600 * SEC)
    late = F.when(F.col("ts_us") >= T0 + 400 * SEC, 1200 * SEC).otherwise(0)
    p, q = (df.withColumn("ts_us", F.col("ts_us") + late).filter(hole) for df in (p, q))
    t = Tape(p, q, s, LOOSE)
    narrow = t.filled.groupBy("symbol", "session").agg(F.count("*").alias("n")).first().n
    assert narrow < 1000  # the hole has one filler
    # levels near the price, so that verdicts are not decided at once
    marks = t.flow.filter("updates_last and seq % 5 = 0").select(
        "symbol", "session", "ts_us", "seq", F.lit(0).cast("long").alias("pref"), F.lit(1).alias("direction"), "price",
        (F.col("price") * 0.9995).alias("level_price"), (F.col("price") * 0.99).alias("invalidation"),
        F.lit(0.5).alias("minute_frac"), "open_us", "close_us")
    got = {(r.symbol, r.seq): r for r in resolve.resolve(marks, t.observations, t.filled, LOOSE).collect()}
    rows = marks.collect()
    assert len(rows) > 150 and all((r.symbol, r.seq) in got for r in rows)
    edges = [r for r in rows if T0 + 330 * SEC < r.ts_us < T0 + 400 * SEC or r.ts_us > T0 + 2050 * SEC]
    assert len(edges) > 20
    wide = replace(LOOSE, gap_cap=10**6)
    end = [(x, 1, T0 + 2500 * SEC, 10**6 + i, 1.0, 1, ["W"], T0, OPEN, T0 + 10**10) for i, x in enumerate(("AAA", "BBB"))]
    full = Tape(p.unionByName(spark.createDataFrame(end, RAW)), q, s, wide)
    want = {(r.symbol, r.seq): r for r in resolve.resolve(marks, full.observations, full.filled, wide).collect()}
    for r in edges:
        a, b = got[r.symbol, r.seq], want[r.symbol, r.seq]
        assert (a.resolution_us, a.resolution_price) == (b.resolution_us, b.resolution_price), r
        assert a.reason == b.reason or "trend" in a.reason + b.reason, (a, b)  # the trend goes on over flat minutes


def test_labels(spark):
    up = [(100.02 + i * 0.003, 100.0 + i * 0.003) for i in range(121)]
    good = _label(spark, up)
    assert good.label and good.label_reason == "expanded" and good.ready
    late = _label(spark, [(h + 0.3, lo + 0.3) for h, lo in up], alert=100.45)
    assert not late.label
    down = _label(spark, [(200 - lo, 200 - h) for h, lo in up], -1, 99.98, 100.1)
    assert down.label and abs(down.mfe - good.mfe) < 1e-9
    short = _label(spark, up[:30])
    assert not short.ready
    flat = _label(spark, [(100.03, 100.01)] * 121)
    assert flat.label_reason == "no_expansion"


def test_stream_equals_batch(spark, tmp_path):
    p, q, _ = make(spark, seconds=400)
    want = Tape(p, q, None, LOOSE).sided
    one = p.withColumn("is_quote", F.lit(False)).unionByName(
        q.withColumn("is_quote", F.lit(True)), allowMissingColumns=True
    )
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(4):  # four files that follow each other in time
        lo, hi = T0 + i * 100 * SEC, T0 + (i + 1) * 100 * SEC
        part = one.filter((F.col("ts_us") >= lo) & (F.col("ts_us") < hi)).coalesce(1)
        part.write.mode("append").parquet(f"{src}")
    events = spark.readStream.schema(one.schema).option("maxFilesPerTrigger", 1).parquet(src)
    live.sides_stream(events, out, str(tmp_path / "cp"), LOOSE).awaitTermination()
    got = spark.read.parquet(f"{out}/sided")
    cols = ["symbol", "seq", "price", "side", "updates_last", "flow_eligible", "quote"]
    assert got.select("batch").distinct().count() == 4
    assert got.select(*cols).exceptAll(want.select(*cols)).count() == 0
    assert want.select(*cols).exceptAll(got.select(*cols)).count() == 0

    stream = spark.readStream.schema(got.schema).option("maxFilesPerTrigger", 2).parquet(f"{out}/sided")
    live.bars_stream(stream, str(tmp_path / "b"), str(tmp_path / "cp2"), LOOSE).awaitTermination()
    done = live.bar_table(spark, str(tmp_path / "b"))
    batch = B.micro_bars(want, LOOSE)
    keep = ["symbol", "b_us", "open", "high", "low", "close", "vol", "buy_vol", "sell_vol", "n"]
    assert done.count() > 100
    assert done.select(*keep).exceptAll(batch.select(*keep)).count() == 0


def test_late_prints_are_counted(spark, tmp_path):
    """Prints that arrive long after their bucket closed: the stream's bars are the batch's, and
    together they hold every print's volume."""
    p, q, _ = make(spark, seed=4, seconds=300)
    lag = F.when(F.col("seq") % 11 == 0, 45 * SEC).when(F.col("seq") % 3 == 0, 2 * SEC).otherwise(0)
    p = p.withColumn("arr_us", F.col("ts_us") + lag)
    tape = Tape(p, q.limit(0), None, LOOSE, late=True)
    rows, want = tape.sided, tape.micro
    src = str(tmp_path / "in")
    order = [T0 + k * 60 * SEC for k in range(7)]
    for lo, hi in zip(order, order[1:], strict=False):
        part = rows.filter((F.col("arr_us") >= lo) & (F.col("arr_us") < hi)).drop("quote")
        part.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(rows.drop("quote").schema).option("maxFilesPerTrigger", 1).parquet(src)
    query = live.bars_stream(stream, str(tmp_path / "b"), str(tmp_path / "cp"), LOOSE)
    query.awaitTermination()
    last = max(int(f.name.split("=")[1]) for f in (tmp_path / "b" / "open").iterdir() if "=" in f.name)
    assert last >= 4
    got = live.bar_table(spark, str(tmp_path / "b"), last)
    keep = ["symbol", "b_us", "open", "high", "low", "close", "vol", "buy_vol", "sell_vol", "n"]
    assert got.select(*keep).exceptAll(want.select(*keep)).count() == 0 and got.count() == want.count() > 100
    total = rows.agg(F.sum("size")).first()[0]
    assert got.agg(F.sum("vol")).first()[0] == total
    assert rows.filter("not updates_last and seq % 11 = 0").count() > 10
    own = B.micro_bars(rows, LOOSE)
    assert own.select("symbol", "b_us", "vol").exceptAll(got.select("symbol", "b_us", "vol")).count() > 10


def test_wire_documents_from_a_folder(spark, tmp_path):
    """Documents that arrive as files are the messages of a batch over the same files."""
    src = tmp_path / "in"
    src.mkdir()
    for k in range(3):
        (src / f"{k}.json").write_text(f'[{{"T":"t","S":"A","i":{k},"x":"V","p":1.5,"s":{k + 1},"t":"2026-08-28T14:30:0{k}Z","c":["@"]}}]\n[{{\n')
    query = (
        live.wire_stream(spark, str(src), 1).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["size"], r.price) for r in wire.trades(got).collect()) == [(1, 1.5), (2, 1.5), (3, 1.5)]
    assert [r.route for r in wire.errors(got).collect()] == ["quarantine"] * 3


def test_streamed_verdicts_and_labels_equal_batch(spark, tmp_path):
    """Ten micro-batches, one symbol silent for minutes: verdicts and ready labels are the batch's."""
    p, q, s = make(spark, seed=6, seconds=700)
    quiet = (F.col("symbol") == "AAA") & F.col("ts_us").between(T0 + 300 * SEC, T0 + 480 * SEC)
    t = Tape(p.filter(~quiet), q.filter(~quiet), s, replace(LOOSE, gap_cap=60), "AAA", "BBB")
    marks = t.flow.filter("updates_last and seq % 9 = 0").select(
        "symbol", "session", "ts_us", "seq", F.lit(0).cast("long").alias("pref"), F.when(F.col("seq") % 2 == 0, 1).otherwise(-1).alias("direction"),
        "price", (F.col("price") * 0.9995).alias("level_price"), (F.col("price") * 0.997).alias("invalidation"),
        F.lit(0.5).alias("minute_frac"), "open_us", "close_us").cache()
    all_events = verdicts.events(marks, t.observations, t.filled, t.profile).cache()
    src = str(tmp_path / "in")
    for k in range(10):
        lo, hi = T0 + 75 * k * SEC, T0 + (75 * k + 75 if k < 9 else 10**6) * SEC
        all_events.filter((F.col("at_us") >= lo) & (F.col("at_us") < hi)).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(all_events.schema).option("maxFilesPerTrigger", 1).parquet(src)
    verdicts.verdict_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), t.profile).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "verdicts"))
    end = t.observations.agg(F.max("o_ts")).first()[0]
    want = resolve.resolve(marks, t.observations, t.filled, t.profile).filter(F.col("resolution_us") <= end)
    cols = [*resolve.CAND, "resolution", "reason", "resolution_us", "resolution_price", F.round("micro_extreme", 9).alias("x"), "env"]
    assert want.count() > 60 and got.count() == want.count()
    assert got.select(*cols).exceptAll(want.select(*cols)).count() == 0
    assert want.groupBy("resolution_us").count().count() > 20 and got.select("batch").distinct().count() > 5
    labels = spark.read.parquet(str(tmp_path / "out" / "labels"))
    due = resolve.label_outcomes(marks, t.filled, t.profile).filter(F.col("ready") & (F.col("due_us") + SEC <= end))
    cols = [*resolve.CAND, "label", "label_reason", "mfe", "mae", "lead_time", "was_late", "due_us"]
    assert labels.count() == due.count() > 60
    assert labels.select(*cols).exceptAll(due.select(*cols)).count() == 0
    # the state does not grow with the tape
    sizes = [spark.read.parquet(str(tmp_path / "out" / "bars" / f"batch={k}")).count() for k in range(10)]
    assert max(sizes) < t.filled.count() / 2


def test_hot_symbol_is_split(spark):
    """The print-level exchange is keyed by time chunks, not by symbol alone."""
    p, q, _ = make(spark, seconds=10)
    from tidemark.operators.ingest import clean
    from tidemark.operators.sides import classify_sides

    df = classify_sides(clean(p), q, LOOSE)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(symbol" in plan and "_chunk" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
