"""What a tape that starts late knows from historical bars.

A run may start at any instant of a session.  Bars of earlier sessions give baselines and
prior-day levels; premarket bars give the premarket range, start the minute trend and stand
in for the seconds before the open; bars of the session itself, complete before the start,
give VWAP sums, extremes, the opening range and the macro history.  All of it is one row per
(symbol, session), which running state takes as its initial carry (``scan.running`` and
``scan.ewma``), so the tape goes on from there instead of starting anew."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scan import ewma
from ..profile import DAY_US, Profile
from .bars import EMA_ALPHA, KEY, hist_to_minutes
from .session import session_for

#: Values of the average that a change over three bars looks back at.
TAIL = 3


@dataclass(frozen=True)
class WarmUp:
    """Historical bars (symbol, ts_us, open, high, low, close, volume, trade_count, vwap) and
    when each session's tape starts (session, start_us).

    ``premarket`` bars give price levels only and may come from another feed than ``minutes``;
    ``days`` are day bars.  Sessions without a start are not warmed up."""

    minutes: DataFrame
    days: DataFrame
    starts: DataFrame
    premarket: DataFrame | None = None
    zone: str = "America/New_York"


def in_sessions(hist: DataFrame, sessions: DataFrame, p: Profile, zone: str) -> DataFrame:
    """Bars in macro-bar shape with the session they belong to."""
    rows = hist_to_minutes(hist, p).withColumn("ts_us", F.col("m_us"))
    found = session_for(rows, sessions, p, zone).filter("found_session is not null")
    return found.select(
        "symbol", F.col("found_session").alias("session"), "m_us", "open", "high", "low", "close",
        "vol", F.lit(0).cast("bigint").alias("buy_vol"), F.lit(0).cast("bigint").alias("sell_vol"),
        "n", "dollar", F.lit(1).cast("bigint").alias("traded_units"),
        F.col("found_open_us").alias("open_us"), F.col("found_close_us").alias("close_us"),
        (F.col("m_us") + p.visibility_us).alias("eff_us"),
    )


def _late(p: Profile) -> Column:
    """Whether the tape starts so late that the session's own bars are needed."""
    return F.col("start_us") > F.col("open_us") + p.macro_us


def _complete(p: Profile) -> Column:
    return F.col("m_us") + p.macro_us <= F.col("start_us")


def session_minutes(minutes: DataFrame, starts: DataFrame, p: Profile) -> DataFrame:
    """The session's own bars that are complete before its tape starts."""
    rows = minutes.join(starts.select("session", "start_us"), "session")
    own = _late(p) & (F.col("m_us") >= F.col("open_us")) & _complete(p)
    return rows.filter(own).select(*minutes.columns)


def premarket_minutes(minutes: DataFrame, starts: DataFrame, p: Profile) -> DataFrame:
    rows = minutes.join(starts.select("session", "start_us"), "session")
    early = (F.col("m_us") >= F.col("open_us") - p.premarket_us) & (F.col("m_us") < F.col("open_us"))
    return rows.filter(early & _complete(p)).select(*minutes.columns)


def state_seeds(minutes: DataFrame, premarket: DataFrame, starts: DataFrame, p: Profile) -> DataFrame:
    """One row per (symbol, session) that is warmed up.

    pmh, pml, pm_close: premarket range and last close; seed_pv, seed_v: VWAP sums; seed_hi,
    seed_lo: session extremes; or_high, or_low: opening range, if the tape starts after it;
    last_price: price before the first print; preopen: the tape starts at the open; ema and
    ema_tail: the minute trend over the premarket and its last values."""
    c = F.col
    own = session_minutes(minutes, starts, p).join(starts.select("session", "start_us"), "session")
    or_end = c("open_us") + p.opening_range_macros * p.macro_us
    opening = (c("m_us") < or_end) & (c("start_us") >= or_end)
    regular = own.groupBy(*KEY).agg(
        F.sum("dollar").alias("seed_pv"),
        F.sum("vol").alias("seed_v"),
        F.max("high").alias("seed_hi"),
        F.min("low").alias("seed_lo"),
        F.max(F.when(opening, c("high"))).alias("or_high"),
        F.min(F.when(opening, c("low"))).alias("or_low"),
        F.max_by("close", "m_us").alias("own_close"),
        F.count("*").alias("seed_minutes"),
        F.first("open_us").alias("_open"),
        F.first("close_us").alias("_close"),
    )
    pm = premarket_minutes(premarket, starts, p)
    ranges = pm.groupBy(*KEY).agg(
        F.max("high").alias("pmh"),
        F.min("low").alias("pml"),
        F.max_by("close", "m_us").alias("pm_close"),
        F.first("open_us").alias("open_us"),
        F.first("close_us").alias("close_us"),
    )
    trend = ewma(pm.filter("close > 0"), KEY, "m_us", c("close"), EMA_ALPHA, "ema")
    # a premarket is a bounded number of bars
    values = F.transform(F.array_sort(F.collect_list(F.struct("m_us", "ema"))), lambda x: x["ema"])
    trend = trend.groupBy(*KEY).agg(values.alias("_v")).select(
        *KEY, F.element_at("_v", -1).alias("ema"),
        F.slice("_v", F.greatest(F.size("_v") - TAIL + 1, F.lit(1)), F.lit(TAIL)).alias("ema_tail"),
    )
    out = ranges.join(regular, list(KEY), "full_outer").join(trend, list(KEY), "left")
    out = out.withColumns({"open_us": F.coalesce("open_us", "_open"), "close_us": F.coalesce("close_us", "_close")})
    out = out.join(starts.select("session", "start_us"), "session")
    return out.withColumns(
        {
            "preopen": ~_late(p) & c("pm_close").isNotNull(),
            "last_price": F.coalesce("own_close", F.when(~_late(p), c("pm_close"))),
        }
    ).drop("_open", "_close", "own_close")


def day_bars(days: DataFrame, zone_day: Column | None = None) -> DataFrame:
    """Historical day bars in the shape of ``session.daily_bars``."""
    day = zone_day if zone_day is not None else F.expr(f"ts_us div {DAY_US}")
    return days.select(
        "symbol", day.alias("session"), "high", "low", "close", F.col("ts_us").alias("day_us")
    )
