"""Stored tapes and bars: pruned scans, feed priority and splicing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scan_range(
    df: DataFrame, symbol: str, ts: str, symbols: Sequence, start: Column, end: Column
) -> DataFrame:
    """Rows of the wanted symbols with start <= ts < end.

    The predicate is on stored columns, so it reaches the file scan (and prunes
    partitions when the table is partitioned by date or symbol)."""
    return df.filter(F.col(symbol).isin(*symbols) & (F.col(ts) >= start) & (F.col(ts) < end))


def in_universe(df: DataFrame, universe: DataFrame, key: str) -> DataFrame:
    """Keep the rows whose key is listed.  Spark broadcasts the list by its own size check."""
    return df.join(universe.select(key).distinct(), key, "left_semi")


def feed_fallback(bars: DataFrame, keys: Sequence[str], priority: Column) -> DataFrame:
    """Per key group keep only the best feed that has any row (lowest ``priority``).

    The winner comes from a map-side combined minimum, not from sorting every row."""
    rows = bars.withColumn("_prio", priority)
    best = rows.groupBy(*keys).agg(F.min("_prio").alias("_prio"))
    return rows.join(best, [*keys, "_prio"], "left_semi").drop("_prio")


def feed_splice(history: DataFrame, live: DataFrame, ts: str, cut: Column) -> DataFrame:
    """History before the cut, the live feed from the cut on."""
    return history.filter(F.col(ts) < cut).unionByName(live.filter(F.col(ts) >= cut))
