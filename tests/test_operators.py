"""Literal-row tests of single operators on a one-second grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from tests.fixtures import QUOTE, SEC, T0, macro, prints, raw
from tidemark import DEFAULT, TUNED
from tidemark.functions.timefn import format_rfc3339, parse_rfc3339_us
from tidemark.operators import bars as B
from tidemark.operators import gates, ingest, levels, metrics, sides, sweeps
from tidemark.operators import session as S
from tidemark.sources import wire

P = DEFAULT


def by(df, *order):
    return df.orderBy(*order).collect()


def test_profiles_differ_only_where_tuned():
    assert (TUNED.break_max_bps, TUNED.score_min, TUNED.prob_gate_min) == (20.0, 0.70, 0.60)
    assert TUNED.sweep_window_s == DEFAULT.sweep_window_s


def test_condition_flags(spark):
    rows = raw(spark, [(i, 10, 1, c) for i, c in enumerate(
        [["@"], [], ["@", "F"], ["@", "I"], ["W"], ["4"], ["@", "7"], ["M"], ["T"]])])
    got = [
        (r.updates_last, r.updates_volume, r.flow_eligible, r.admin)
        for r in by(ingest.with_condition_flags(rows), "seq")
    ]
    full, odd, vol = (True, True, True), (False, True, True), (False, True, False)
    assert [g[:3] for g in got[:7]] == [full, full, full, odd, vol, vol, vol]
    assert got[7][3] and not any(g[3] for g in got[:7])
    assert got[8][:2] == (False, True)


def test_late_print_keeps_only_volume(spark):
    rows = ingest.clean(raw(spark, [(100, 10, 1, ["@"]), (97, 10, 1, ["@"]), (99, 10, 1, ["@"])]))
    got = by(ingest.late_demote(rows, P), "seq")
    assert [r.updates_last for r in got] == [True, False, True]
    assert [r.flow_eligible for r in got] == [True, False, True]
    assert all(r.updates_volume for r in got)


def test_gap_fill_and_first_high(spark):
    tape = prints(spark, [(0.2, 10.0, 100), (0.7, 10.05, 100), (4.1, 10.10, 100)])
    got = by(B.gap_fill(B.micro_bars(tape, P), P), "b_us")
    assert len(got) == 5 and [b.filled for b in got] == [False, True, True, True, False]
    assert (got[0].high, got[0].vol) == (10.05, 200)
    assert all(b.vol == 0 and b.close == 10.05 for b in got[1:4])


def test_wide_gap_gets_one_filler(spark):
    tape = prints(spark, [(0, 10.0, 1), (2000, 11.0, 1)])
    got = by(B.gap_fill(B.micro_bars(tape, P), P), "b_us")
    assert [(b.b_us - T0) // SEC for b in got] == [0, 1999, 2000]


def test_minute_fold(spark):
    # T0 lies on a minute boundary
    tape = prints(spark, [(i, 10 + 0.01 * i, 50) for i in range(130)])
    got = by(B.macro_bars(B.micro_bars(tape, P), P), "m_us")
    assert (got[0].vol, got[0].open, round(got[0].close, 2)) == (3000, 10.0, 10.59)
    assert round(got[1].open, 2) == 10.60
    assert got[0].eff_us - got[0].m_us == 61 * SEC


def test_volume_only_print_moves_no_price(spark):
    tape = prints(
        spark,
        [(0, 10.0, 50), (0.5, 99.0, 500, 0, False, True, False), (1, 10.02, 50)],
    )
    got = by(B.micro_bars(tape, P), "b_us")
    assert sum(b.vol for b in got) == 600 and max(b.high for b in got) == 10.02
    assert got[0].high == 10.0 and got[-1].close == 10.02


def test_vwap_and_session_extremes(spark):
    tape = prints(spark, [(-5, 50, 10), (1, 10, 100), (2, 20, 100)], open_us=T0)
    filled = B.gap_fill(B.micro_bars(tape, P), P)
    got = by(B.print_windows(tape, B.with_bar_windows(filled), P), "seq")
    assert got[0].vwap is None and got[2].vwap == 15.0
    assert (got[2].session_high, got[2].session_low) == (20.0, 10.0)


def test_window_includes_partial_second(spark):
    tape = prints(spark, [(i, 10, 100) for i in range(10)] + [(10, 10, 999)])
    filled = B.gap_fill(B.micro_bars(tape, P), P)
    got = by(B.print_windows(tape, B.with_bar_windows(filled), P), "seq")
    assert got[-1].v5 == 1399


def test_rolling_windows_match_recomputation(spark):
    import random

    rng = random.Random(5)
    rows, at = [], 0.0
    for _ in range(300):
        at += rng.choice([0.1, 0.4, 1.3, 3.7])
        rows.append((round(at, 3), 100 + rng.random(), rng.randint(1, 9), rng.choice([-1, 0, 1])))
    tape = prints(spark, rows)
    filled = B.gap_fill(B.micro_bars(tape, P), P)
    got = by(B.print_windows(tape, B.with_bar_windows(filled), P), "seq")
    for i, g in enumerate(got):
        now = int((T0 + round(rows[i][0] * SEC)) // SEC)
        for w, v, b in ((5, g.v5, g.b5), (15, g.v15, g.b15), (60, g.v60, g.b60)):
            seen = [
                r for r in rows[: i + 1] if (T0 + round(r[0] * SEC)) // SEC > now - w
            ]
            assert v == sum(r[2] for r in seen)
            assert b == sum(r[2] for r in seen if r[3] > 0)


def test_ema_matches_fold(spark):
    closes = [100.0 + (i * 37 % 11) for i in range(60)]
    got = by(B.with_ema_slope(macro(spark, [(c + 1, c - 1, c) for c in closes])), "m_us")
    ema, seen = None, []
    for c, g in zip(closes, got, strict=True):
        ema = c if ema is None else 2 / 21 * c + 19 / 21 * ema
        seen.append(ema)
        assert abs(g.ema20 - ema) < 1e-9
        want = None if len(seen) < 4 else (seen[-1] - seen[-4]) / c * 1e4
        assert g.ema_slope is None if want is None else abs(g.ema_slope - want) < 1e-6


def test_side_classification(spark):
    trades = raw(spark, [(1, 10.0, 1, ["@"]), (2, 10.1, 1, ["@"]), (3, 10.2, 1, ["@"]),
                         (4, 10.0, 1, ["@"]), (5, 10.1, 1, ["@"]), (6, 10.1, 1, ["@"])])
    quotes = spark.createDataFrame(
        [("X", 1, T0 + 2 * SEC, 0, 10.0, 1, 10.2, 1), ("X", 1, T0 + 4 * SEC, 1, 0.0, 1, 9.0, 1)],
        QUOTE,
    )
    got = [r.side for r in by(sides.classify_sides(ingest.clean(trades), quotes, P), "seq")]
    # no quote and no previous price; tick up (equal-time quote unseen); ask; bid;
    # mid falls back to the tick rule; mid and equal price
    assert got == [0, 1, 1, -1, 1, 0]


def test_swings_and_ranges(spark):
    flat = [(100.3, 99.9)] * 8
    bars = macro(spark, flat + [(100.9, 99.9)] + [(100.3, 99.9)] * 4)
    last = by(levels.macro_structure(bars, P), "m_us")[-1]
    found = {(x.kind, x.price) for x in last.dynamic}
    assert {(8, 100.9), (10, 100.3), (12, 100.9)} <= found


def test_compression(spark):
    bars = macro(spark, [(101.0, 100.0)] * 10 + [(100.5, 100.42)] * 3)
    last = by(levels.compression(bars, P), "m_us")[-1]
    assert last.comp_active and last.comp_ratio < 0.25


def test_merge_prefers_priority(spark):
    df = spark.range(1).select(
        F.array(levels.level(F.lit(101.001), "PMH"), levels.level(F.lit(101.0), "PDH"),
                levels.level(F.lit(102.0), "RANGE_H")).alias("a")
    )
    merged = df.select(levels.merge_levels(F.col("a"), P).alias("m")).first().m
    assert [(x.kind, x.price) for x in merged] == [(0, 101.0), (8, 102.0)]


def _sweep(spark, rows, price=100.0):
    tape = prints(spark, [(t, px, 1) for t, px in rows]).withColumn(
        "b_us", F.col("ts_us") - F.col("ts_us") % SEC
    )
    lv = F.array(levels.level(F.lit(price), "PDH"))
    buckets = tape.select("symbol", "session", "b_us").distinct().select(
        "*", F.lit(0).cast("bigint").alias("epoch"), lv.alias("levels")
    )
    epochs = spark.createDataFrame(
        [("X", 1, 0, price, 0, 0)],
        "symbol string, session bigint, epoch bigint, price double, prio int, kind int",
    )
    obs = sweeps.level_observations(tape, buckets, epochs, P)
    return by(sweeps.sweep_reclaims(obs, P), "ts_us")


def test_sweep_and_reclaim(spark):
    got = _sweep(spark, [(0, 99.95), (5, 100.05), (8, 100.08), (12, 99.97)])
    # the first crossing upward also ends a short excursion below
    assert [(r.direction, r.swept_extreme) for r in got][-1] == (-1, 100.08)
    assert len([r for r in got if r.direction == -1]) == 1


def test_deep_break_is_no_reclaim(spark):
    got = _sweep(spark, [(0, 99.95), (5, 100.50), (8, 99.97)])
    assert not [r for r in got if r.direction == -1]


def test_sweeps_match_sequential_fold(spark):
    import random

    rng = random.Random(3)
    rows, at = [], 0.0
    for _ in range(400):
        at += rng.choice([0.2, 0.6, 2.0, 30.0])
        px = 100 + rng.choice([-0.3, -0.15, -0.05, 0.0, 0.05, 0.15, 0.3])
        rows.append((round(at, 1), round(px, 2)))
    want, state = [], None
    for t, px in rows:
        above = px > 100.0
        if state is None or state[0] != above:
            if state is not None:
                age, exc = t - state[1], abs(state[2] - 100.0) / 100.0 * 1e4
                if age <= P.sweep_window_s + 1e-9 and exc <= P.sweep_max_bps:
                    want.append((T0 + round(t * SEC), -1 if state[0] else 1, state[2]))
            state = [above, t, px]
        else:
            state[2] = max(state[2], px) if above else min(state[2], px)
    got = [(r.ts_us, r.direction, r.swept_extreme) for r in _sweep(spark, rows)]
    assert got == want and len(want) > 5


def test_all_fresh_reclaims_match(spark):
    """Twelve reclaims within the age limit, at bucket edges and at one instant; older ones do not."""
    age = P.us(P.reclaim_age_s)
    at = (T0 // age + 3) * age
    stamps = [at - age - 1, at - age, at - age + 1, *[at - 1 - k for k in range(5)], *[at + k for k in range(5)], at + age]
    events = [("X", 1, ts, k, 10.0 + k, 0, 1 if k % 2 else -1, 9.0) for k, ts in enumerate(stamps)]
    reclaims = spark.createDataFrame(events, "symbol string, session bigint, ts_us bigint, seq bigint, level double, kind int, direction int, swept_extreme double")
    asked = [(at, 9), (at + age, 99), (at + 2 * age, 100), (at - age, 0)]
    rows = spark.createDataFrame([("X", 1, ts, seq, 1.0) for ts, seq in asked], "symbol string, session bigint, ts_us bigint, seq bigint, price double")
    got = sorted((r.ts_us, r.seq, r.r_ts_us) for r in sweeps.active_reclaims(rows, reclaims, P).collect())
    want = sorted((ts, seq, e) for ts, seq in asked for k, e in enumerate(stamps) if (e < ts or (e == ts and k <= seq)) and ts - e <= age)
    assert got == want and sum(ts == at for ts, _, _ in got) > 7


def test_penalty_value(spark):
    row = spark.createDataFrame(
        [(1.6, 3.0, 0.0, 1)], "comp_ratio double, vol_ratio_prev double, imb15 double, direction int"
    )
    assert abs(row.select(gates.penalty(P).alias("p")).first().p - 0.15) < 1e-9


def test_calendar_and_early_close(spark):
    raw_days = spark.createDataFrame(
        [("2026-11-25", "09:30", "16:00"), ("2026-11-27", "09:30", "13:00"),
         ("2026-07-01", "09:30", "16:00")],
        "date string, open string, close string",
    )
    got = {r.date: r for r in S.calendar(raw_days).collect()}
    assert got["2026-11-25"].minutes == 390 and got["2026-11-27"].minutes == 210
    assert got["2026-11-25"].open_us % (86_400 * SEC) == 14.5 * 3600 * SEC
    assert got["2026-07-01"].open_us % (86_400 * SEC) == 13.5 * 3600 * SEC


def test_time_round_trip(spark):
    df = spark.createDataFrame(
        [("2026-08-28T14:30:01.123456789Z",), ("2026-08-28T10:30:01.5-04:00",), ("bad",)], "t string"
    )
    got = [r[0] for r in df.select(format_rfc3339(parse_rfc3339_us(F.col("t")))).collect()]
    assert got == ["2026-08-28T14:30:01.123456Z", "2026-08-28T14:30:01.500000Z", None]


def test_wire_documents(spark):
    doc = (
        '[{"T":"t","S":"TSLA","i":5,"x":"V","p":350.22,"s":130,'
        '"t":"2026-08-28T14:30:01.123456789Z","c":["@","I"],"z":"C"},'
        '{"T":"q","S":"TSLA","bp":350.2,"bs":4,"ap":350.24,"as":6,"t":"2026-08-28T14:30:01.2Z"},'
        '{"T":"q","S":"TSLA","bp":0.0,"bs":0,"ap":350.0,"as":1,"t":"2026-08-28T14:30:01Z"},'
        '{"T":"c","S":"TSLA"},{"T":"success","msg":"authenticated"},'
        '{"T":"error","code":402},{"T":"error","code":406}]'
    )
    msgs = wire.messages(spark.createDataFrame([(doc,), ("[{",)], "raw string"))
    t = wire.trades(msgs).collect()
    q = wire.quotes(msgs).collect()
    e = sorted(r.route for r in wire.errors(msgs).collect())
    assert len(t) == 1 and t[0].conditions == ["@", "I"] and t[0].size == 130
    assert len(q) == 1 and q[0].ask == 350.24
    assert e == ["fatal", "quarantine", "retry"]


def test_recap_arithmetic(spark):
    rows = spark.createDataFrame(
        [("a", 1, 100.0, 101.0), ("b", 1, 100.0, 99.0), ("c", -1, 100.0, 100.5)],
        "signal_id string, direction int, resolution_price double, close_price double",
    ).withColumns({"price_at_resolution": F.lit(None).cast("double"), "alert_price": F.lit(1.0),
                   "d": F.lit("2026-01-02")})
    got = metrics.recap(metrics.efficacy_outcomes(rows), "d")
    one = got.withColumn("text", metrics.recap_text(F.col("d"))).first()
    assert (one.confirmed, one.favorable) == (3, 1) and round(one.avg_move_bps, 1) == -16.7
    assert "33% efficacy" in one.text and "avg -17 bps" in one.text
