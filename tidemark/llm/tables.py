"""Input tables, and node-to-component links as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.durable import durable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, cast, so that extra columns and their names cannot clash."""
    return df.select(*[F.col(f"`{name}`").cast(kind).alias(name) for name, kind in columns.items()])


def remainder(column, divisor: int):
    """crc32 of an id as text, modulo ``divisor``; null ids have none."""
    return F.crc32(F.col(column).cast("string")) % divisor


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (a, b): root is the smallest node reachable.

    Alternating large and small stars: each round is two grouped minima and two equi-joins,
    edges never outnumber the input, and the number of rounds grows with the logarithm of
    the longest chain.  Every round is written to the shared folder, so lineage stays short.
    The hub of a large group is a grouped minimum (combined before the shuffle) and a join
    that Spark can split; no group is gathered."""
    pairs = durable(_two_ways(edges.select("a", "b")).distinct(), "links")
    before = None
    for _ in range(rounds):
        large = _star(pairs, larger=True)
        small = durable(_star(large.where("a <> b").distinct(), larger=False).distinct(), "links")
        mark = small.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        pairs = durable(_two_ways(small), "links") if mark != before else small
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    # settled: every edge is (node, root) with root < node; roots name themselves
    stars = pairs.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root")).groupBy("node").agg(F.min("root").alias("root"))


def _two_ways(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Link the larger (or the not larger) neighbours of each node to its smallest one."""
    if not larger:
        edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
    both = edges.join(low, "a")
    if larger:
        out = both.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        return out.where("a <> b")
    out = both.select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b")))
    return out.where("a <> b")
