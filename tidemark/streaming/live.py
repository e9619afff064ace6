"""Structured Streaming: the batch operators over an arriving tape.

Sides need the state of everything seen before (latest quote, last flow price,
watermark).  Instead of one Python state per symbol, every micro-batch runs the batch
operators on its own rows plus one carry row per symbol, so a hot symbol stays spread
over chunks and no per-row Python runs.  Outputs and carry go to folders named by batch
id and are overwritten on a retry, which makes the sink idempotent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import bars, sides
from ..operators.ingest import clean, late_demote, rebucket_late
from ..profile import Profile
from ..sources import wire

KEY = ["symbol", "session"]
CARRY = (
    "symbol string, session bigint, "
    "quote struct<bid:double,bid_size:bigint,ask:double,ask_size:bigint>, "
    "flow_price double, watermark_us bigint"
)


def wire_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Messages from a folder of wire documents, one JSON array per line."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return wire.messages(raw.withColumnRenamed("value", "raw"))


def _carry(spark: SparkSession, out: str, batch_id: int) -> DataFrame:
    if batch_id == 0:
        return spark.createDataFrame([], CARRY)
    return spark.read.schema(CARRY).parquet(f"{out}/carry/batch={batch_id - 1}")


def demote_with_carry(prints: DataFrame, carry: DataFrame, p: Profile) -> DataFrame:
    """Late rows against the watermark of earlier batches (within a batch: arrival order)."""
    seen = late_demote(prints, p).drop("late")
    before = carry.groupBy("symbol").agg(F.max("watermark_us").alias("_w"))
    rows = seen.join(before, "symbol", "left")
    late = F.coalesce(F.col("ts_us") < F.col("_w") - p.us(p.late_grace), F.lit(False))
    return (
        rows.withColumn("updates_last", F.col("updates_last") & ~late)
        .withColumn("flow_eligible", F.col("flow_eligible") & ~late)
        .drop("_w", "watermark_us")
    )


def sides_batch(
    trades: DataFrame, quotes: DataFrame, carry: DataFrame, p: Profile
) -> tuple[DataFrame, DataFrame]:
    """(sided prints of this batch, carry for the next one).

    The carried quote and flow price stand just before the batch's first row, so every
    row of the batch sees them."""
    c = F.col
    rows = demote_with_carry(clean(trades), carry, p)
    good = sides.valid_quotes(quotes)
    first = (
        rows.select(*KEY, "ts_us")
        .unionByName(good.select(*KEY, "ts_us"))
        .groupBy(*KEY)
        .agg((F.min("ts_us") - 1).alias("ts_us"))
    )
    known = carry.join(first, KEY)
    back = F.lit(-1).cast("bigint").alias("seq")
    old_quotes = known.filter("quote is not null").select(*KEY, "ts_us", back, "quote.*")
    old_flow = known.filter("flow_price is not null").select(
        *KEY, "ts_us", back, c("flow_price").alias("price"), F.lit(True).alias("flow_eligible"),
        F.lit(False).alias("updates_last"),
    )
    prints = rows.unionByName(old_flow, allowMissingColumns=True)
    all_quotes = good.select(*old_quotes.columns).unionByName(old_quotes)
    sided = sides.classify_sides(prints, all_quotes, p).filter("seq >= 0")

    order = F.struct("ts_us", "seq")
    new_quote = all_quotes.groupBy(*KEY).agg(
        F.max_by(F.struct(*sides.QUOTE_FIELDS), order).alias("quote")
    )
    new_flow = prints.groupBy(*KEY).agg(
        F.max_by("price", F.when(c("flow_eligible"), order)).alias("flow_price"),
        F.max(F.when(c("seq") >= 0, c("ts_us"))).alias("_w"),
    )
    fresh = new_quote.join(new_flow, KEY, "full_outer")
    old = carry.select(
        *KEY, c("quote").alias("_q"), c("flow_price").alias("_f"), c("watermark_us").alias("_o")
    )
    merged = fresh.join(old, KEY, "full_outer").select(
        *KEY,
        F.coalesce("quote", "_q").alias("quote"),
        F.coalesce("flow_price", "_f").alias("flow_price"),
        F.greatest("_w", "_o").alias("watermark_us"),
    )
    return sided, merged


def sides_stream(events: DataFrame, out: str, checkpoint: str, p: Profile) -> StreamingQuery:
    """Classify an arriving tape: (symbol, session, ts_us, seq, is_quote, ...) rows.

    ``events`` holds trades and quotes in one stream, so both advance together.  Back
    pressure comes from the source's per-trigger limits; nothing is dropped."""
    trade_cols = [
        "symbol", "session", "ts_us", "seq", "price", "size", "conditions", "arr_us", "open_us",
        "close_us",
    ]
    quote_cols = ["symbol", "session", "ts_us", "seq", *sides.QUOTE_FIELDS]

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        trades = batch.filter(~F.col("is_quote")).select(*trade_cols)
        quotes = batch.filter("is_quote").select(*quote_cols)
        sided, carry = sides_batch(trades, quotes, _carry(spark, out, batch_id), p)
        sided.write.mode("overwrite").parquet(f"{out}/sided/batch={batch_id}")
        carry.write.mode("overwrite").parquet(f"{out}/carry/batch={batch_id}")

    return (
        events.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


OPEN_PRINTS = (
    "symbol", "session", "b_us", "ts_us", "seq", "arr_us", "price", "size", "side", "updates_last",
    "updates_volume", "flow_eligible", "open_us", "close_us",
)


def bars_batch(sided: DataFrame, still_open: DataFrame, p: Profile) -> tuple[DataFrame, DataFrame]:
    """(prints of buckets that closed, prints of the open bucket of each symbol).

    A print joins the newest bucket its symbol had reached when it arrived, so a late one is
    counted there and none is dropped.  ``still_open`` are the prints of the open buckets so
    far: a unit of time a symbol, however long the stream runs."""
    newest = still_open.groupBy(*KEY).agg(F.max("b_us").alias("b_us"))
    rows = rebucket_late(sided, p, newest).select(*OPEN_PRINTS).unionByName(still_open)
    reached = rows.groupBy(*KEY).agg(F.max("b_us").alias("_newest"))
    rows = rows.join(reached, KEY)
    closed, left = F.col("b_us") < F.col("_newest"), F.col("b_us") == F.col("_newest")
    return rows.filter(closed).drop("_newest"), rows.filter(left).drop("_newest")


def bars_stream(sided: DataFrame, out: str, checkpoint: str, p: Profile) -> StreamingQuery:
    """Bars of an arriving sided tape, each written once, when its bucket closes.

    No watermark decides what is too late: see :func:`bars_batch`.  Read the bars with
    :func:`bar_table`."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        kind = batch.select(*[c for c in OPEN_PRINTS if c != "b_us"], F.lit(0).cast("long").alias("b_us"))
        schema = kind.select(*OPEN_PRINTS).schema
        before = spark.createDataFrame([], schema)
        if batch_id:
            before = spark.read.schema(schema).parquet(f"{out}/open/batch={batch_id - 1}")
        closed, left = bars_batch(kind.drop("b_us"), before, p)
        aggregates = closed.groupBy(*KEY, "b_us").agg(*bars.bar_aggregates("arr_us"))
        aggregates.write.mode("overwrite").parquet(f"{out}/bars/batch={batch_id}")
        left.write.mode("overwrite").parquet(f"{out}/open/batch={batch_id}")

    return (
        sided.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def bar_table(spark: SparkSession, out: str, last_batch: int | None = None) -> DataFrame:
    """The bars written so far; with ``last_batch``, also those still open after it."""
    closed = spark.read.parquet(f"{out}/bars").drop("batch")
    if last_batch is not None:
        left = spark.read.parquet(f"{out}/open/batch={last_batch}")
        closed = closed.unionByName(left.groupBy(*KEY, "b_us").agg(*bars.bar_aggregates("arr_us")))
    return bars.finish_bars(closed)
