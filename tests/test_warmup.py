"""A tape that starts late, warmed up from historical bars."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark import DEFAULT
from tidemark.functions.scan import Running, ewma, running
from tidemark.operators import bars as B
from tidemark.operators import session as S
from tidemark.operators import warmup
from tidemark.plans.pipeline import Tape
from tests.fixtures import QUOTE, RAW

P = DEFAULT
DAY = 86_400_000_000
MIN = 60_000_000
SESSION = 20_468  # a winter day: New York opens at 14:30 UTC
OPEN = SESSION * DAY + 14 * 60 * MIN + 30 * MIN
BAR = (
    "symbol string, ts_us bigint, open double, high double, low double, close double, "
    "volume bigint, trade_count bigint, vwap double"
)


def bar(ts, close, high=None, low=None, volume=1200, vwap=None):
    high, low = high or close + 1, low or close - 1
    return ("X", ts, float(close), float(high), float(low), float(close), volume, 120, vwap if vwap is not None else close - 0.25)


@pytest.fixture(scope="module")
def sessions(spark):
    rows = [(s, s * DAY + OPEN % DAY, s * DAY + OPEN % DAY + 390 * MIN) for s in (SESSION - 1, SESSION)]
    return spark.createDataFrame(rows, "session bigint, open_us bigint, close_us bigint")


def started(spark, at):
    return spark.createDataFrame([(SESSION, at)], "session bigint, start_us bigint")


# The bars and expected seeds of the mid-session case in FIXTURES.md.
HISTORY = [
    bar(OPEN - 2 * MIN, 103, 105, 102),
    bar(OPEN - MIN, 104, 106, 103),
    bar(OPEN, 105, 107, 104),
    bar(OPEN + MIN, 106, 108, 105),
]


def test_mid_session_values(spark, sessions):
    minutes = warmup.in_sessions(spark.createDataFrame([bar(OPEN - DAY, 99), *HISTORY], BAR), sessions, P, S.NEW_YORK)
    got = warmup.state_seeds(minutes, minutes, started(spark, OPEN + 20 * MIN), P).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.session, r.pmh, r.pml, r.pm_close) == (SESSION, 106.0, 102.0, 104.0)
    assert (r.seed_pv, r.seed_v) == (104.75 * 1200 + 105.75 * 1200, 2400)
    assert (r.seed_hi, r.seed_lo, r.or_high, r.or_low) == (108.0, 104.0, 108.0, 104.0)
    assert (r.seed_minutes, r.preopen, r.last_price) == (2, False, 106.0)
    assert r.ema == pytest.approx(103 + (104 - 103) * 2 / 21) and r.ema_tail[0] == 103.0
    days = spark.createDataFrame([bar((SESSION - 1) * DAY, 100, 110, 90), bar(SESSION * DAY, 7, 8, 6)], BAR)
    daily = spark.createDataFrame([("X", SESSION, None, None, None, OPEN, SESSION * DAY)],
                                  "symbol string, session bigint, high double, low double, close double, open_us bigint, day_us bigint")
    prior = S.prior_day_levels(daily, P, warmup.day_bars(days)).first()
    assert (prior.pdh, prior.pdl, prior.pdc) == (110.0, 90.0, 100.0)


def test_start_inside_the_opening_range_and_at_the_open(spark, sessions):
    minutes = warmup.in_sessions(spark.createDataFrame(HISTORY, BAR), sessions, P, S.NEW_YORK)
    early = warmup.state_seeds(minutes, minutes, started(spark, OPEN + 2 * MIN), P).first()
    assert early.or_high is None and early.seed_v == 2400
    at_open = warmup.state_seeds(minutes, minutes, started(spark, OPEN), P).first()
    assert at_open.seed_v is None and at_open.preopen and at_open.last_price == 104.0
    none = warmup.state_seeds(minutes.limit(0), minutes.limit(0), started(spark, OPEN), P)
    assert none.count() == 0


def test_prior_day_looks_back_as_far_as_needed(spark):
    """A long break between sessions, and an earlier bar whose stamp is too recent."""
    rows = [("X", s, float(s), float(s) - 1, float(s), at, s * DAY) for s, at in
            ((10, 10 * DAY), (11, 11 * DAY), (12, 12 * DAY), (13, 13 * DAY - 40 * 3_600_000_000))]
    daily = spark.createDataFrame(rows, "symbol string, session bigint, high double, low double, close double, open_us bigint, day_us bigint")
    got = {r.session: r.pdh for r in S.prior_day_levels(daily, P).collect()}
    # session 13 opens so early that the bars of 12 and 11 are both stamped after its cut
    assert got == {10: None, 11: 10.0, 12: 11.0, 13: 10.0}


def test_running_goes_on_from_an_initial_row(spark):
    rng = random.Random(3)
    rows = [(k, t // 50, t, rng.choice([None, rng.randint(-9, 9)])) for k in "ab" for t in range(200)]
    df = spark.createDataFrame(rows, "k string, chunk int, t int, x int")
    first = spark.createDataFrame([("a", 100, 5, 7)], "k string, total int, low int, latest int")
    specs = [Running("total", "sum", F.col("x")), Running("low", "min", F.col("x")), Running("latest", "last", F.col("x")), Running("own", "max", F.col("x"))]
    got = {(r.k, r.t): (r.total, r.low, r.latest, r.own) for r in running(df, ["k"], "chunk", ["t"], specs, initial=first).collect()}
    for k, start in (("a", (100, 5, 7)), ("b", (None, None, None))):
        total, low, latest = start
        own = None
        for _, _, t, x in [r for r in rows if r[0] == k]:
            if x is not None:
                total, low, latest = (total or 0) + x, x if low is None else min(low, x), x
                own = x if own is None else max(own, x)
            assert got[k, t] == (total, low, latest, own), (k, t)


def test_average_goes_on_from_an_initial_value(spark):
    xs = [float(i % 7) for i in range(9000)]
    whole = spark.createDataFrame([("a", i, x) for i, x in enumerate(xs)], "k string, i int, x double")
    full = {r.i: r.e for r in ewma(whole, ["k"], "i", F.col("x"), 0.1, "e").collect()}
    start = spark.createDataFrame([("a", full[4999])], "k string, e double")
    rest = ewma(whole.filter("i >= 5000"), ["k"], "i", F.col("x"), 0.1, "e", start).collect()
    assert len(rest) == 4000 and all(r.e == pytest.approx(full[r.i], rel=1e-9) for r in rest)


def tape_rows():
    rng = random.Random(11)
    rows, price = [], 100.0
    for i in range(6000):
        ts = OPEN - 20 * MIN + i * 700_000 + rng.randrange(600_000)
        price = round(price + rng.choice([-0.02, -0.01, 0.0, 0.01, 0.02]), 2)
        rows.append(("X", SESSION, ts, i, price, rng.randint(1, 9) * 10, ["@"], ts, OPEN, OPEN + 390 * MIN))
    return rows


@pytest.mark.parametrize("late", [0, 2, 30])
def test_a_late_start_equals_the_whole_tape(spark, sessions, late):
    """Bars made of the missed prints: from the start on, everything known is as if the tape were whole."""
    rows = tape_rows()
    start = OPEN + late * MIN
    quotes = spark.createDataFrame([], QUOTE)
    whole = Tape(spark.createDataFrame(rows, RAW), quotes, sessions, P)
    bars = {}
    for _, _, ts, _, price, size, *_ in rows:
        bars.setdefault(ts // MIN * MIN, []).append((price, size))
    hist = [("X", m, b[0][0], max(p for p, _ in b), min(p for p, _ in b), b[-1][0], sum(s for _, s in b), len(b),
             sum(p * s for p, s in b) / sum(s for _, s in b)) for m, b in sorted(bars.items())]
    hist = spark.createDataFrame(hist, BAR)
    warm = warmup.WarmUp(hist, hist.limit(0), started(spark, start))
    cut = Tape(spark.createDataFrame([r for r in rows if r[2] >= start], RAW), quotes, sessions, P, warm=warm)

    def state(t):
        prints = B.print_windows(t.sided, B.with_bar_windows(t.filled, (), (), (), t.seeds), P, ())
        prints = {r.seq: r for r in prints.filter(F.col("ts_us") >= start).collect()}
        macro = {r.m_us: r for r in t.structure.filter(F.col("eff_us") > start + MIN).collect()}
        return prints, macro, t.static.first(), t.opening.first()

    (p0, m0, s0, o0), (p1, m1, s1, o1) = state(whole), state(cut)
    assert p0.keys() == p1.keys() and len(p0) > 1000
    for seq, a in p0.items():
        b = p1[seq]
        assert a.vwap == pytest.approx(b.vwap, rel=1e-9), seq
        assert (a.side, a.session_high, a.session_low) == (b.side, b.session_high, b.session_low)
    assert sorted((s0.pmh, s0.pml)) == sorted((s1.pmh, s1.pml))
    if late != 2:  # a tape that starts inside the opening range sees the rest of it only
        assert (o0.or_high, o0.or_low, o0.or_eff_us) == (o1.or_high, o1.or_low, o1.or_eff_us)
    assert m1.keys() == m0.keys()
    for m, a in m0.items():
        assert a.ema_change == pytest.approx(m1[m].ema_change, rel=1e-6, abs=3e-9), m
        if late == 30:
            assert (a.range5m, a.ext_hi, a.ext_lo) == (m1[m].range5m, m1[m].ext_hi, m1[m].ext_lo)
