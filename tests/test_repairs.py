"""Cases that earlier versions got wrong."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import functions as F

from tidemark import TUNED
from tidemark.functions.expr import order_key
from tidemark.operators import arbiter, ingest

P = TUNED


def candidate(session, ts, seq, **more):
    base = {
        "run_id": "r", "session": session, "symbol": "A", "ts_us": ts, "seq": seq, "pref": 0, "direction": 1, "bucket": 1,
        "level_price": 100.0, "score": 99.0, "penalty": 0.0, "vol_ratio_prev": 99.0, "comp_active": False, "is_trend": False,
        "prob": None, "efficacy_prob": None, "resolution": None, "resolution_us": None, "ready": None, "due_us": None, "label": None, "was_late": None,
    }
    return SimpleNamespace(**(base | more))


def test_a_new_session_frees_symbols_and_budget():
    state = arbiter._Session(P, adapt=True)
    state.start_day("d1")
    assert state.decide(candidate("d1", 1_000_000, 1))[0] == "SIGNAL"  # live at the close
    assert state.decide(candidate("d1", 900_000_000, 2, level_price=120.0))[0] is None
    gate = state.gate
    state.start_day("d2")
    assert state.decide(candidate("d2", 90_000_000_000, 3))[0] == "SIGNAL"
    assert state.gate is gate


def test_models_and_trends():
    state = arbiter._Session(P, adapt=True)
    low = {"prob": 0.0, "efficacy_prob": float("nan"), "score": 0.0}
    assert state._suppressed(candidate("d", 1, 1, **low))
    assert not state._suppressed(candidate("d", 1, 1, **low, is_trend=True))
    assert state._suppressed(candidate("d", 1, 1, is_trend=True, score=0.0, efficacy_prob=0.0))
    assert not state._suppressed(candidate("d", 1, 1, efficacy_prob=0.0, score=P.prob_bypass_score))


def test_backfill_leaves_live_rows_alone(spark):
    cols = "session string, symbol string, exchange string, trade_id long, ts_us long, seq long, price double, size long"
    gap = P.us(P.backfill_gap) * 3
    live = [("d1", "A", "X", 1, 0, 0), ("d1", "A", "X", None, gap, 1), ("d1", "A", "X", None, gap + 1, 2), ("d2", "A", "X", 1, 0, 3)]
    past = [("d1", "A", "X", 1, 5, 4), ("d1", "A", "X", 7, 6, 5), ("d2", "A", "X", 7, 6, 6)]
    live, past = ([(*r, 1.0, 1) for r in rows] for rows in (live, past))
    out = ingest.gap_backfill(spark.createDataFrame(live, cols), spark.createDataFrame(past, cols), P)
    assert sorted((r.seq, r.is_backfill) for r in out.collect()) == [(0, False), (1, False), (2, False), (3, False), (5, True)]


def test_backfill_keeps_rows_without_an_id(spark):
    """A missing id identifies nothing: only the very row that is live already goes."""
    cols = "session string, symbol string, exchange string, trade_id long, ts_us long, seq long, price double, size long"
    gap = P.us(P.backfill_gap) * 3
    live = [("d1", "A", "X", None, 0, 0, 5.0, 10), ("d1", "A", "X", None, gap, 1, 5.0, 10)]
    past = [("d1", "A", "X", None, 0, 2, 5.0, 10), ("d1", "A", "X", None, 7, 3, 5.0, 10), ("d1", "A", "X", None, gap, 4, 5.0, 11)]
    past += [("d1", "A", "X", None, 7, 5, 5.0, 10), ("d1", "A", "X", 3, 8, 6, 5.0, 10), ("d1", None, "X", None, 9, 7, 5.0, 10)]
    out = ingest.gap_backfill(spark.createDataFrame(live, cols), spark.createDataFrame(past, cols), P)
    assert sorted((r.seq, r.is_backfill) for r in out.collect()) == [(0, False), (1, False), (3, True), (4, True), (5, True), (6, True), (7, True)]


def test_order_key_with_signed_minors(spark):
    rows = [(1, 9 * 10**18), (2, -9 * 10**18), (1, -5), (1, 0), (-3, 7)]
    df = spark.createDataFrame(rows, "a long, b long").orderBy(order_key(F.col("a"), F.col("b")))
    assert [tuple(r) for r in df.collect()] == sorted(rows)


def test_price_at_long_after_the_last_bar(spark, monkeypatch):
    from types import SimpleNamespace

    from tidemark.catalog import bars
    from tidemark.catalog.base import P

    end = P.macro_us - P.unit_us
    late = P.macro_us * P.session_macros * 5
    prints = [("A", 1, end - 1, 1), ("A", 1, end, 2), ("A", 1, late, 3), ("B", 1, late, 4)]
    fake = SimpleNamespace(
        sided=spark.createDataFrame(prints, "symbol string, session long, ts_us long, seq long"),
        macro=spark.createDataFrame([("A", 1, 0, 7.0)], "symbol string, session long, m_us long, close double"),
    )
    monkeypatch.setattr(bars, "tape", lambda *_: fake)
    got = {r.seq: r.minute_close for r in bars.price_at(spark, "").collect()}
    assert got == {1: None, 2: 7.0, 3: 7.0, 4: None}
