"""Minute-of-session volume baselines from completed sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..profile import Profile
from .session import completed_before


def macro_idx(ts: Column, open_us: Column, p: Profile) -> Column:
    """Index of the macro bar since the open."""
    return F.floor((ts - open_us) / p.macro_us)


def minute_baseline(macro: DataFrame, sessions: DataFrame, p: Profile) -> DataFrame:
    """Median volume and print count per (symbol, session, index) over the last sessions.

    Only traded bars inside a session count.  Each bar is sent to the few sessions
    that look back at it, so work is (bars x baseline sessions)."""
    bars = macro.filter(
        (F.col("traded_units") > 0)
        & (F.col("m_us") >= F.col("open_us"))
        & (F.col("m_us") < F.col("close_us"))
    ).select(
        "symbol",
        F.col("session").alias("prior_session"),
        macro_idx(F.col("m_us"), F.col("open_us"), p).alias("idx"),
        "vol",
        "n",
    )
    bars = bars.filter((F.col("idx") >= 0) & (F.col("idx") < p.session_macros))
    look = completed_before(sessions, p.baseline_sessions).select("session", "prior_session")
    return (
        bars.join(look, "prior_session")
        .groupBy("symbol", "session", "idx")
        .agg(
            F.median(F.col("vol").cast("double")).alias("vol_med"),
            F.median(F.col("n").cast("double")).alias("n_med"),
        )
    )


def baseline_fallback(baseline: DataFrame, p: Profile) -> DataFrame:
    """Per (symbol, session): medians of the non-zero medians, and the midday ruler."""
    vol, n, idx = F.col("vol_med"), F.col("n_med"), F.col("idx")
    mid = (idx >= p.midday_from) & (idx < p.midday_to) & (vol > 0)
    return (
        baseline.groupBy("symbol", "session")
        .agg(
            F.coalesce(F.median(F.when(vol > 0, vol)), F.lit(0.0)).alias("vol_fallback"),
            F.coalesce(F.median(F.when(n > 0, n)), F.lit(0.0)).alias("n_fallback"),
            F.median(F.when(mid, vol)).alias("_mid"),
        )
        .select(
            "symbol",
            "session",
            "vol_fallback",
            "n_fallback",
            (F.col("vol_fallback") > 0).alias("ready"),
            (F.coalesce("_mid", "vol_fallback") / p.macro_slices).alias("midday5"),
        )
    )


def with_baseline(
    rows: DataFrame, baseline: DataFrame, fallback: DataFrame, idx: str = "idx"
) -> DataFrame:
    """Look up (symbol, session, idx): own median, else the symbol's, else 0."""
    b = baseline.withColumnRenamed("idx", idx)
    joined = rows.join(b, ["symbol", "session", idx], "left").join(
        fallback, ["symbol", "session"], "left"
    )

    def pick(own: str, general: str) -> Column:
        return F.coalesce(F.when(F.col(own) > 0, F.col(own)), F.col(general), F.lit(0.0))

    return (
        joined.withColumn("base_vol", pick("vol_med", "vol_fallback"))
        .withColumn("base_n", pick("n_med", "n_fallback"))
        .withColumn("midday5", F.coalesce("midday5", F.lit(0.0)))
        .drop("vol_med", "n_med", "vol_fallback", "n_fallback", "ready")
    )
