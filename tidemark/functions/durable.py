"""Stage tables: cut a plan at a shared, reliable place (never executor-local disk)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT: dict[str, str] = {}


def stage_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only a local session without that
    setting (tests) gets a fresh temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if named:
        return named
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    if sc.applicationId not in _LOCAL_ROOT:
        _LOCAL_ROOT[sc.applicationId] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _LOCAL_ROOT[sc.applicationId]


def durable(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as parquet below the stage root and read it back.

    Readers get column pruning and filter pushdown, the plan above starts from a file
    scan, and a lost executor costs nothing upstream."""
    spark = df.sparkSession
    path = f"{stage_root(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
