"""Verdicts and labels of live candidates over an arriving tape.

A live candidate has two timers: its verdict falls at the first observation that decides, at
the latest at its deadline, and its label is due a window later.  Every micro-batch advances
the clock of the tape and runs the batch operators on what is still pending: candidates without
verdict or label, and of the tape only what they can still see.  A verdict is out once its
instant is not later than the clock; one that falls in silence (no bar of the symbol) comes
from ``resolve.timers`` as soon as the clock has passed it.  State expires with the session's
close.  Results and state go to folders named by batch id, so a repeated batch overwrites itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.durable import durable
from ..operators import resolve
from ..profile import Profile

KEY = ["symbol", "session"]
CAND = [*resolve.CAND, "direction", "price", "level_price", "invalidation", "minute_frac", "open_us", "close_us"]
BAR = [*KEY, "b_us", "high", "low", "close", "buy_vol", "sell_vol", "vol", "close_us"]
OBS = [*KEY, *resolve.OBS]
STATE = ("pending", "obs", "bars")


def events(cands: DataFrame, obs: DataFrame, bars: DataFrame, p: Profile) -> DataFrame:
    """One stream of all three: ``kind``, ``at_us`` (when the row is known) and a struct each.

    A bar is known at its end, everything else at its own instant."""
    c = F.col
    kinds = (
        ("cand", cands.select(c("ts_us").alias("at_us"), F.struct(*CAND).alias("cand"))),
        ("obs", obs.select(c("o_ts").alias("at_us"), F.struct(*OBS).alias("obs"))),
        ("bar", bars.select((c("b_us") + p.unit_us).alias("at_us"), F.struct(*BAR).alias("bar"))),
    )
    out = None
    for name, df in kinds:
        df = df.withColumn("kind", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def verdict_batch(
    pending: DataFrame, obs: DataFrame, bars: DataFrame, clock: int, p: Profile
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(verdicts, labels, still pending) as of ``clock``.

    ``pending`` has the candidate columns and ``decided`` and ``labelled``."""
    keys = list(resolve.CAND)
    waiting = pending.filter("not decided").select(*CAND)
    verdicts = resolve.resolve(waiting, obs, bars, p, durable).filter(F.col("resolution_us") <= clock)
    unlabelled = pending.filter("not labelled").select(*CAND)
    labels = resolve.label_outcomes(unlabelled, bars, p).filter(F.col("ready") & (F.col("due_us") + p.unit_us <= clock))
    left = (
        pending.join(verdicts.select(*keys, F.lit(True).alias("_v")), keys, "left")
        .join(labels.select(*keys, F.lit(True).alias("_l")), keys, "left")
        .withColumn("decided", F.col("decided") | F.coalesce("_v", F.lit(False)))
        .withColumn("labelled", F.col("labelled") | F.coalesce("_l", F.lit(False)))
        .drop("_v", "_l")
    )
    # a candidate whose session is over gets nothing any more
    live = ~(F.col("decided") & F.col("labelled")) & (F.col("close_us") + p.unit_us > clock)
    return verdicts, labels, left.filter(live)


def still_seen(rows: DataFrame, at: str, pending: DataFrame, clock: int, p: Profile) -> DataFrame:
    """Tape that a pending candidate, or one of the next batch, can still look at."""
    back = p.us(resolve.SHORT + 1)
    first = pending.groupBy(*KEY).agg((F.min("ts_us") - back).alias("_from"))
    open_end = F.least(F.coalesce("_from", F.lit(clock - back)), F.lit(clock - back))
    return rows.join(first, KEY, "left").filter(F.col(at) >= open_end).drop("_from")


def verdict_stream(stream: DataFrame, out: str, checkpoint: str, p: Profile) -> StreamingQuery:
    """Verdicts and ready labels as the tape arrives; ``stream`` has the columns of :func:`events`."""
    fields = {f.name: f.dataType for f in stream.schema.fields}

    def state(spark: SparkSession, name: str, schema: StructType, batch_id: int) -> DataFrame:
        if batch_id == 0:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{out}/{name}/batch={batch_id - 1}")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        fresh = {k: batch.filter(F.col("kind") == k).select(f"{k}.*") for k in ("cand", "obs", "bar")}
        old = StructType([*fields["cand"].fields]).add("decided", "boolean").add("labelled", "boolean")
        new = fresh["cand"].withColumns({"decided": F.lit(False), "labelled": F.lit(False)})
        pending = state(spark, "pending", old, batch_id).unionByName(new)
        obs = state(spark, "obs", fields["obs"], batch_id).unionByName(fresh["obs"])
        bars = state(spark, "bars", fields["bar"], batch_id).unionByName(fresh["bar"])
        # one number: how far the tape has come
        clock = batch.agg(F.max("at_us")).first()[0] or 0
        verdicts, labels, left = verdict_batch(pending, obs, bars, clock, p)
        verdicts.write.mode("overwrite").parquet(f"{out}/verdicts/batch={batch_id}")
        labels.write.mode("overwrite").parquet(f"{out}/labels/batch={batch_id}")
        left.write.mode("overwrite").parquet(f"{out}/pending/batch={batch_id}")
        kept = spark.read.schema(old).parquet(f"{out}/pending/batch={batch_id}")
        still_seen(obs, "o_ts", kept, clock, p).write.mode("overwrite").parquet(f"{out}/obs/batch={batch_id}")
        still_seen(bars, "b_us", kept, clock, p).write.mode("overwrite").parquet(f"{out}/bars/batch={batch_id}")
        batch.unpersist()

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
