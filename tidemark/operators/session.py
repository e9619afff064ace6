"""Calendar, session lookup and session-anchored price levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scan import asof_rows
from ..functions.timefn import local_day, wall_to_utc_us
from ..profile import DAY_US, Profile

NEW_YORK = "America/New_York"
KEY = ("symbol", "session")


def calendar(raw: DataFrame, zone: str = NEW_YORK) -> DataFrame:
    """(date, open 'HH:MM', close 'HH:MM') in local wall time to UTC session bounds."""
    return (
        raw.withColumn("open_us", wall_to_utc_us(F.col("date"), F.col("open"), zone))
        .withColumn("close_us", wall_to_utc_us(F.col("date"), F.col("close"), zone))
        .select(
            "date",
            F.expr(f"{_day_number()}").alias("session"),
            "open_us",
            "close_us",
            F.expr("(close_us - open_us) div 60000000").alias("minutes"),
        )
    )


def _day_number() -> str:
    return "cast(datediff(cast(date as date), date'1970-01-01') as bigint)"


def session_for(rows: DataFrame, sessions: DataFrame, p: Profile, zone: str) -> DataFrame:
    """Session whose [open - lead, close] holds the row; null columns when none does.

    The lead never reaches the previous local day, so the lookup is an equi-join on the
    local day plus a range test: no range join, and the calendar side is broadcast by
    Spark itself only when its size allows."""
    found = sessions.select(
        F.col("session").alias("_day"),
        F.col("session").alias("found_session"),
        F.col("open_us").alias("found_open_us"),
        F.col("close_us").alias("found_close_us"),
    )
    keyed = rows.withColumn("_day", local_day(F.col("ts_us"), zone))
    hit = F.col("ts_us").between(
        F.col("found_open_us") - p.lookup_lead_us, F.col("found_close_us")
    )
    joined = keyed.join(found, "_day", "left").drop("_day")
    return joined.withColumns(
        {c: F.when(hit, F.col(c)) for c in ("found_session", "found_open_us", "found_close_us")}
    )


def rows_in_session(rows: DataFrame, sessions: DataFrame, zone: str) -> DataFrame:
    """Rows with open <= ts < close, with their session and macro index inputs."""
    s = sessions.select(
        F.col("session").alias("_day"),
        F.col("open_us").alias("in_open_us"),
        F.col("close_us").alias("in_close_us"),
    )
    keyed = rows.withColumn("_day", local_day(F.col("ts_us"), zone))
    return (
        keyed.join(s, "_day")
        .filter((F.col("ts_us") >= F.col("in_open_us")) & (F.col("ts_us") < F.col("in_close_us")))
        .drop("_day")
    )


def completed_before(sessions: DataFrame, n: int) -> DataFrame:
    """For every session its last ``n`` completed ones: (session, prior_session, age).

    Works on the calendar alone (one row per trading day)."""
    w = W.orderBy("session")
    order = sessions.select("session", F.row_number().over(w).alias("_i"))
    prior = order.select(F.col("session").alias("prior_session"), F.col("_i").alias("_j"))
    ages = F.explode(F.sequence(F.lit(1), F.lit(n))).alias("age")
    return (
        order.select("session", "_i", ages)
        .withColumn("_j", F.col("_i") - F.col("age"))
        .join(prior, "_j")
        .select("session", "prior_session", F.col("age").cast("bigint").alias("age"))
    )


def daily_bars(bars: DataFrame) -> DataFrame:
    """Day bars stamped at the start of their day."""
    return (
        bars.groupBy(*KEY)
        .agg(
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "b_us").alias("close"),
            F.first("open_us").alias("open_us"),
        )
        .withColumn("day_us", F.col("session") * DAY_US)
    )


def prior_day_levels(daily: DataFrame, p: Profile, history: DataFrame | None = None) -> DataFrame:
    """High, low and close of the last day bar stamped before open - cutoff, however long ago.

    Bars come from ``history`` where it has the day, else from ``daily``.  The session's own
    (partial) bar never counts, whatever its stamp.  Day bars are a row a day and symbol."""
    bars = daily.select(*KEY, "high", "low", "close", "day_us")
    if history is not None:
        own = bars.join(history.select(*KEY), list(KEY), "left_anti")
        bars = history.select(*bars.columns).unionByName(own)
    bar = F.struct("high", "low", "close").alias("_p")
    cut = F.least(F.col("open_us") - p.prior_cutoff_us, F.col("day_us"))
    asks = daily.select(*KEY, cut.alias("_cut"))
    found = asof_rows(asks, bars.select("symbol", "day_us", bar), ["symbol"], "_cut", "day_us", ["_p"], strict=True)
    return found.select(
        *KEY,
        F.col("_p.high").alias("pdh"),
        F.col("_p.low").alias("pdl"),
        F.col("_p.close").alias("pdc"),
    )


def premarket_levels(bars: DataFrame, p: Profile) -> DataFrame:
    """Extremes and last close of the premarket, [open - premarket length, open)."""
    pre = bars.filter(
        (F.col("b_us") >= F.col("open_us") - p.premarket_us) & (F.col("b_us") < F.col("open_us"))
    )
    return pre.groupBy(*KEY).agg(
        F.max("high").alias("pmh"),
        F.min("low").alias("pml"),
        F.max_by("close", "b_us").alias("pm_close"),
    )


def opening_range(prints: DataFrame, p: Profile) -> DataFrame:
    """Price-forming extremes of the first macro bars, usable from ``or_eff_us`` on."""
    end = F.col("open_us") + p.opening_range_macros * p.macro_us
    rows = prints.filter(
        F.col("updates_last") & (F.col("ts_us") >= F.col("open_us")) & (F.col("ts_us") < end)
    )
    return rows.groupBy(*KEY).agg(
        F.max("price").alias("or_high"),
        F.min("price").alias("or_low"),
        F.first(end).alias("or_eff_us"),
    )
