"""Learning, stores, messages and reports."""

from __future__ import annotations

import random
import shutil
from dataclasses import replace

from pyspark.sql import functions as F

from tests.fixtures import SEC, T0
from tidemark import DEFAULT, TUNED
from tidemark.functions.scan import Running, ewma, running
from tidemark.operators import arbiter, gate as gate_op, learn, metrics, outbox, quality, store
from tidemark.plans import arbitration


def outcomes(spark, n=400, seed=2):
    rng = random.Random(seed)
    rows = [
        ("run", i, rng.choice("AB"), rng.randrange(3), rng.random() < 0.4, rng.random() < 0.3)
        for i in range(n)
    ]
    cols = "run_id string, seq bigint, symbol string, bucket int, label boolean, was_late boolean"
    return rows, spark.createDataFrame(rows, cols)


def test_running_matches_plain_loop(spark):
    rng = random.Random(9)
    rows = [("K" if rng.random() < 0.7 else "L", i, rng.choice([None, 1.0, 2.0, 5.0]))
            for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i bigint, v double")
    df = df.withColumn("c", F.expr("i div 20"))
    specs = [Running("last", "last", F.col("v"), inclusive=False),
             Running("sum", "sum", F.col("v")), Running("top", "max", F.col("v"))]
    got = {r.i: r for r in running(df, ["k"], "c", ["i"], specs).collect()}
    state = {}
    for k, i, v in rows:
        s = state.setdefault(k, {"last": None, "sum": None, "top": None})
        assert got[i].last == s["last"]
        if v is not None:
            s["last"] = v
            s["sum"] = (s["sum"] or 0) + v
            s["top"] = max(s["top"] or v, v)
        assert (got[i].sum, got[i].top) == (s["sum"], s["top"])


def test_ewma_over_many_blocks(spark):
    xs = [((i * 7919) % 101) / 10 for i in range(6000)]
    df = spark.createDataFrame([("K", i, x) for i, x in enumerate(xs)], "k string, i bigint, x double")
    got = {r.i: r.e for r in ewma(df, ["k"], "i", F.col("x"), 0.3, "e").collect()}
    e = None
    for i, x in enumerate(xs):
        e = x if e is None else e + 0.3 * (x - e)
        assert abs(got[i] - e) < 1e-9


def test_drift_over_many_rows_of_one_key(spark):
    """Ten thousand ids of one key, drift that builds up across chunks; averages never restart."""
    loss = lambda i: 0.3 + (i * 7919 % 101) / 400 + (0.9 if 4000 <= i < 4300 or i > 8190 else 0.0)
    ids = [i for i in range(10_000) if i % 13]
    rows = spark.createDataFrame([("K", i, i // 100, loss(i)) for i in ids] + [("L", 5, 0, 1.0)], "k string, seq bigint, day bigint, loss double")
    drift = learn.drift_monitor(rows, ["k"], "seq").cache()
    got = {(r.k, r.seq): r for r in drift.collect()}
    fast = slow = None
    on, starts = False, set()
    for n, i in enumerate(ids, 1):
        x = loss(i)
        fast = x if fast is None else fast + 0.30 * (x - fast)
        slow = x if slow is None else slow + 0.02 * (x - slow)
        r = got["K", i]
        assert r.n == n and abs(r.fast - fast) < 1e-9 and abs(r.slow - slow) < 1e-9
        was, on = on, n > 30 and fast > slow + 0.25
        assert r.drift == on
        if on and not was:
            starts.add(i // 100)
    assert {r.day for r in learn.drift_refits(drift, ["k"], "seq", "day").collect()} == starts and len(starts) == 2


def test_drift_forces_a_refit(spark):
    """A model fitted after the drift knows what the one before it could not."""
    rows = [(i, 1 if i % 2 else -1, i // 20, float(i % 5), (i % 5 > 2) != (i // 20 >= 30), True) for i in range(1000)]
    df = spark.createDataFrame(rows, "signal_id bigint, direction int, session bigint, x double, label boolean, ready boolean")
    plain = learn.walkforward_scores(df, ("x",), replace(TUNED, min_labels=20), 25, 0, 49)
    forced = learn.walkforward_scores(df, ("x",), replace(TUNED, min_labels=20), 25, 0, 49, drifted=[39])
    versions = lambda out: {(r.session, r.model_version) for r in out.select("session", "model_version").distinct().collect()}
    assert {v for _, v in versions(plain)} == {"lr-0", "lr-25"}
    assert {s for s, v in versions(forced) if v == "lr-40"} == set(range(40, 50))
    early = lambda out: {r.signal_id: r.prob for r in out.filter("session < 40").collect()}
    assert early(plain) == early(forced)


def test_multipliers_equal_sequential_product(spark):
    rows, df = outcomes(spark)
    p = DEFAULT
    want = {}
    for _, _, s, b, label, late in rows:
        f = 1 - p.adapt_step if label else 1 + p.adapt_step * (2 if late else 1)
        want[s, b] = max(p.bound_low, min(p.bound_high, want.get((s, b), 1.0) * f))
    got = {(r.symbol, r.bucket): r.mult for r in learn.adaptive_multipliers(df, p).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_timeline_follows_gate_state(spark):
    rows, df = outcomes(spark)
    p = replace(DEFAULT, min_labels=10, revert_window=10, revert_precision_drop=0.05)
    got = {r.seq: r for r in gate_op.gate_timeline(df, p).collect()}
    gate = arbiter.GateState(p)
    for _, seq, s, b, label, late in rows:
        gate.learn((s, b), label, late)
        g = got[seq]
        assert (g.n_labels, g.reverted, g.version) == (gate.labels, gate.reverted, gate.version)
    assert max(r.version for r in got.values()) > 1


def test_rolling_precision_window(spark):
    rows, df = outcomes(spark)
    got = {r.seq: r.precision for r in learn.rolling_precision(df, ["run_id"], DEFAULT).collect()}
    labels = [r[4] for r in rows]
    for i in range(len(labels)):
        seen = labels[max(0, i - 29) : i + 1]
        assert abs(got[i] - sum(seen) / len(seen)) < 1e-12


def test_walkforward_uses_only_the_past(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        x = rng.random()
        rows.append((i, i // 10, 1 if i % 2 else -1, x, x + rng.gauss(0, 0.2) > 0.5, True))
    cols = "id bigint, session bigint, direction int, x double, label boolean, ready boolean"
    df = spark.createDataFrame(rows, cols)
    a = learn.walkforward_scores(df, ("x",), DEFAULT, 20, 0, 59)
    flipped = df.withColumn(
        "label", F.when(F.col("session") >= 40, ~F.col("label")).otherwise(F.col("label"))
    )
    b = learn.walkforward_scores(flipped, ("x",), DEFAULT, 20, 0, 59)
    one = {r.id: r.prob for r in a.collect()}
    two = {r.id: r.prob for r in b.collect()}
    assert all(one[i] is None for i in range(200)) and one[250] is not None
    assert all(one[i] == two[i] for i in range(600))  # later labels change nothing here


def test_a_run_goes_on_with_its_kept_models(spark, tmp_path):
    rng = random.Random(11)
    rows = [(i, i // 20, 1 if i % 2 else -1, x, x + rng.gauss(0, 0.2) > 0.5, True) for i in range(1000) for x in (rng.random(),)]
    df = spark.createDataFrame(rows, "id bigint, session bigint, direction int, x double, label boolean, ready boolean")
    p, keep = replace(TUNED, min_labels=20), str(tmp_path / "models")
    probs = lambda out: {r.id: r.prob for r in out.collect()}
    whole = probs(learn.walkforward_scores(df, ("x",), p, 25, 0, 49))
    early = probs(learn.walkforward_scores(df.filter("session < 30"), ("x",), p, 25, 0, 29, keep=keep))
    assert early == {i: x for i, x in whole.items() if i < 600}
    # labels that changed since: kept models do not follow them, models without a marker would
    other = df.withColumn("label", F.when(F.col("session") < 25, ~F.col("label")).otherwise(F.col("label")))
    assert probs(learn.walkforward_scores(other, ("x",), p, 25, 0, 49, keep=keep)) == whole
    shutil.rmtree(tmp_path / "models" / "direction=1" / "session=25" / "whole")
    again = probs(learn.walkforward_scores(other, ("x",), p, 25, 0, 49, keep=keep))
    assert all((again[i] == whole[i]) == (i % 2 == 0) for i in range(500, 1000))


def test_scores_join_the_candidates(spark):
    """Missing scores stay null, repeated ones count once, runs may differ."""
    ids = "symbol string, session bigint, ts_us bigint, seq bigint, pref bigint"
    rows = spark.createDataFrame([("r", "X", 1, t, 0, 0, None, None) for t in (1, 2, 3)], f"run_id string, {ids}, prob double, efficacy_prob double")
    scores = spark.createDataFrame([("X", 1, 1, 0, 0, 0.9, None), ("X", 1, 1, 0, 0, 0.2, 0.7), ("X", 1, 2, 0, 0, None, 0.1), ("Y", 1, 3, 0, 0, 0.5, 0.5)], f"{ids}, prob double, efficacy_prob double")
    got = {r.ts_us: (r.prob, r.efficacy_prob) for r in arbitration.with_scores(rows, scores).collect()}
    assert got == {1: (0.2, 0.7), 2: (None, 0.1), 3: (None, None)}
    own = scores.withColumn("run_id", F.lit("other"))
    assert {r.prob for r in arbitration.with_scores(rows, own).collect()} == {None}


def test_latest_and_daily_payload(spark, tmp_path):
    facts = spark.createDataFrame(
        [(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 1, "z")], "id int, version int, v string"
    )
    got = {r.id: r.v for r in store.latest(facts, ["id"], F.col("version")).collect()}
    assert got == {1: "c", 2: "z"}
    day = spark.createDataFrame([("d1", "X"), ("d1", "X"), ("d2", "X")], "d string, s string")
    payload = store.daily_payload(day, "d", "s", {"alerts": F.count("*")})
    path = str(tmp_path / "daily")
    store.save_daily(payload, path)
    store.save_daily(payload.filter("date = 'd1'").withColumn("payload", F.lit("broken")), path)
    read = store.read_payload(spark.read.parquet(path), "alerts bigint")
    assert {r.date: r.p.alerts for r in read.collect()} == {"d1": None, "d2": 1}


def test_messages_are_short_and_unique(spark):
    base = ("S-1-U", "X", 1, 100.0, "break", 2.5, 99.5, 100.7, "", "with market", "10:00:00")
    rows = [(*base, k, why) for k, why in (("EARLY", ""), ("CONFIRMED", "volume sustained"),
            ("FAILED", "no expansion progress"), ("FAILED", "hit invalidation"), ("EARLY", ""))]
    df = spark.createDataFrame(
        rows,
        "signal_id string, symbol string, direction int, trigger_price double, verb string, "
        "vol_ratio double, invalidation double, micro_extreme double, env string, context string, "
        "clock string, kind string, reason string",
    )
    out = outbox.outbox(df, "T ").collect()
    assert len(out) == 3 and all(len(r.text.split()) < 40 for r in out)
    early = next(r for r in out if r.kind == "EARLY")
    assert early.priority == 0 and early.text.startswith("T EARLY UP X 10:00:00 ET | 100.00 break")


def test_detection_verdicts(spark):
    m = 60 * SEC
    truth = spark.createDataFrame(
        [("A", 1, "breakout_up", 1, T0, T0 + 5 * m), ("B", 1, "quiet", 1, T0, T0 + m),
         ("C", 1, "fakeout_up", 1, T0, T0 + m), ("D", 1, "quiet", 1, T0, T0 + m)],
        "symbol string, session bigint, kind string, direction int, event_us bigint, "
        "move_end_us bigint",
    )
    alerts = spark.createDataFrame(
        [("A", 1, 1, T0 - 4 * SEC), ("A", 1, 1, T0 + SEC), ("A", 1, -1, T0 - 5 * SEC),
         ("D", 1, 1, T0)],
        "symbol string, session bigint, direction int, ts_us bigint",
    )
    got = metrics.detection_eval(truth, alerts, 5 * SEC, m).collect()
    assert {r.symbol: r.verdict for r in got} == {
        "A": "DETECTED", "B": "OK", "C": "MISSED", "D": "FALSE_ALERTS"}
    assert next(r.delay_us for r in got if r.symbol == "A") == -4 * SEC


def test_profile_rules(spark):
    good = dict(imb15_min=0.1, outcome_window_s=300, ring_seconds=600, bound_low=0.75,
                bound_high=1.5, min_labels=40, efficacy_min_labels=40, prob_gate_min=0.45,
                efficacy_prob_gate_min=0.6)
    bad = {**good, "outcome_window_s": 20, "prob_gate_min": 1.5}
    df = spark.createDataFrame([good, bad])
    got = quality.check_profiles(df).orderBy("prob_gate_min").collect()
    assert got[0].valid and got[1].problems == ["outcome_window_s", "prob_gate_min"]


def test_outbox_has_every_alert_with_its_verdict(spark):
    """One first message for each signal that was sent, trends among them, and one for each verdict."""
    import __spark_entry__ as entry

    sf_dir = "/root/testdata/sf0.001"
    rows = entry.queries()["outbox"](spark, sf_dir).collect()
    sent = [r for r in entry.queries()["signals"](spark, sf_dir).collect() if not r.suppressed]
    kinds = [r.key.rsplit(":", 1)[1] for r in rows]
    assert kinds.count("EARLY") == len(sent) and len(rows) - len(sent) == sum(r.resolution is not None for r in sent)
    trends = {r.signal_id for r in sent if r.trigger_verb == "trend"}
    told = {r.key.rsplit(":", 1)[0] for r in rows if "baseline | pressure sustained" in r.text}
    assert trends and told == trends
