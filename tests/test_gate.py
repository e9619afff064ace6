"""The adaptive gate over many labels against a plain loop, and continued from snapshots."""

from __future__ import annotations

import random
from dataclasses import replace

import pytest

from tidemark import DEFAULT
from tidemark.functions.durable import durable
from tidemark.operators import arbiter, gate, learn

COLS = "run_id string, seq bigint, symbol string, bucket int, label boolean, was_late boolean"
P = replace(DEFAULT, min_labels=30, revert_window=20, revert_precision_drop=0.12)


def outcomes(n, seed, runs=("hot", "cold"), share=0.9):
    """Most labels in one run; hits come and go in long swings, ids have holes."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        good = 0.65 if (i // 700) % 2 == 0 else 0.35
        run = runs[0] if rng.random() < share else runs[1]
        rows.append((run, i * 3 + rng.randrange(3), rng.choice("AAB"), rng.randrange(2), rng.random() < good, rng.random() < 0.3))
    return rows


def plain(rows, p):
    """{(run, seq): state} and the gates after all labels."""
    gates, out = {}, {}
    for run, seq, symbol, bucket, label, late in sorted(rows, key=lambda r: (r[0], r[1])):
        g = gates.setdefault(run, arbiter.GateState(p))
        g.learn((symbol, bucket), label, late)
        out[run, seq] = (g.labels, g.version, g.reverted, g.active, g.mult.get((symbol, bucket), 1.0))
    return out, gates


def held(df):
    return {(r.run_id, r.seq): (r.n_labels, r.version, r.reverted, r.active, r.mult) for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k][:4] == w[:4], (k, got[k], w)
        assert got[k][4] == pytest.approx(w[4], abs=1e-9), k


def test_timeline_over_many_chunks(spark):
    """Twelve thousand labels of one run: several chunks, reverts in most of them."""
    rows = outcomes(13_000, 5)
    want, gates = plain(rows, P)
    assert gates["hot"].version > 20
    shuffled = random.Random(1).sample(rows, len(rows))
    same(held(gate.gate_timeline(spark.createDataFrame(shuffled, COLS), P)), want)


@pytest.mark.parametrize("p", [
    replace(P, min_labels=3, revert_window=4), replace(P, min_labels=400, revert_window=100),
    replace(P, revert_precision_drop=-1.0), replace(P, revert_precision_drop=2.0), replace(P, adapt_step=0.4),
])
def test_timeline_for_other_profiles(spark, p):
    """Always low, never low, steps that jump to the bounds, baselines that come late."""
    rows = outcomes(1500, 8)
    same(held(gate.gate_timeline(spark.createDataFrame(rows, COLS), p)), plain(rows, p)[0])


def test_no_labels(spark):
    none = spark.createDataFrame([], COLS)
    assert gate.gate_timeline(none, P).collect() == [] and gate.snapshot(none, P).collect() == []
    assert learn.adaptive_multipliers(none, P).collect() == []


def test_multipliers_of_one_key_over_many_chunks(spark):
    rows = outcomes(13_000, 6, share=1.0)
    want = {}
    for _, _, s, b, label, late in rows:
        f = 1 - P.adapt_step if label else 1 + P.adapt_step * (2 if late else 1)
        want[s, b] = max(P.bound_low, min(P.bound_high, want.get((s, b), 1.0) * f))
    got = {(r.symbol, r.bucket): r.mult for r in learn.adaptive_multipliers(spark.createDataFrame(rows, COLS), P).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


@pytest.mark.parametrize("cut", [12, 31, 2000])
def test_a_reloaded_run_equals_an_uninterrupted_one(spark, tmp_path, cut):
    """Cut before the baseline, just after it and far inside; one run starts only after the cut."""
    rows = outcomes(4200, 9, share=0.97)
    rows += [("new", 20_000 + i, "A", 0, i % 3 > 0, False) for i in range(90)]
    early, later = rows[:cut], rows[cut:]
    path = str(tmp_path / "gates")
    gate.save(gate.snapshot(spark.createDataFrame(early, COLS), P, stage=durable), path, 1)
    state = gate.load(spark, path, 1)
    want, gates = plain(rows, P)
    own = {(r[0], r[1]) for r in later}
    same(held(gate.gate_timeline(spark.createDataFrame(later, COLS), P, state, durable)), {k: w for k, w in want.items() if k in own})
    # the state after the second half, as one run and as two
    whole = {r.run_id: r for r in gate.snapshot(spark.createDataFrame(rows, COLS), P, stage=durable).collect()}
    gate.save(gate.snapshot(spark.createDataFrame(later, COLS), P, state, durable), path, 2)
    parts = {r.run_id: r for r in gate.load(spark, path).collect()}
    assert parts.keys() == whole.keys() == gates.keys()
    for run, g in gates.items():
        for r in (whole[run], parts[run]):
            assert (r.n_labels, r.version, r.wakes_at, r.baseline) == (g.labels, g.version, g.wakes_at, g.baseline)
            assert {(m.symbol, m.bucket): pytest.approx(m.mult, abs=1e-9) for m in r.mults} == g.mult
            newest = list(g._hits)
            assert [int(x) for x in r.recent] == [b - a for a, b in zip(newest, newest[1:], strict=False)]


def test_snapshots_are_chosen_by_run_and_session(spark, tmp_path):
    path = str(tmp_path / "gates")
    rows = outcomes(300, 3)
    for session, n in ((1, 100), (2, 200), (4, 300)):
        part = rows[:n] if session < 4 else [r for r in rows if r[0] == "hot"]
        gate.save(gate.snapshot(spark.createDataFrame(part, COLS), P, stage=durable), path, session)
    # written twice: the same again, not two states
    gate.save(gate.snapshot(spark.createDataFrame(rows[:200], COLS), P, stage=durable), path, 2)
    count = lambda k: sum(r[0] == k for r in rows[:200])
    got = {r.run_id: r.n_labels for r in gate.load(spark, path, 3).collect()}
    assert got == {"hot": count("hot"), "cold": count("cold")}
    got = {r.run_id: r.n_labels for r in gate.load(spark, path).collect()}
    assert got == {"hot": sum(r[0] == "hot" for r in rows), "cold": count("cold")}
