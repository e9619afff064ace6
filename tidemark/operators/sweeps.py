"""Sweep-and-reclaim events: short excursions through a level that come back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.expr import floor_us
from ..functions.scan import Running, running
from ..profile import Profile

KEY = ("symbol", "session")
LEVEL_KEY = ("kind", "cents")
AGE_SLICES = 4


def lifetimes(epochs: DataFrame) -> DataFrame:
    """Runs of consecutive epochs in which a level key stays listed.

    A level's sweep state survives exactly as long as its key (kind, price to the cent)
    is listed at every epoch start."""
    keyed = epochs.select(*KEY, "epoch", "kind", F.round("price", 2).alias("cents")).distinct()
    w = W.partitionBy(*KEY, *LEVEL_KEY).orderBy("epoch")
    return keyed.withColumn("life", F.col("epoch") - F.row_number().over(w))


def level_observations(
    prints: DataFrame, buckets: DataFrame, epochs: DataFrame, p: Profile
) -> DataFrame:
    """What each level saw, with print detail only where a level was actually crossed.

    ``prints``: price-forming prints with ``b_us``; ``buckets``: (.., b_us, epoch, levels).
    A bucket whose prices stay on one side of a level gives one summary row; only
    buckets whose range contains the level are expanded to prints.  So the fan-out of
    prints is the number of levels inside one bucket's range, not all levels."""
    order = F.struct("ts_us", "seq")
    ranges = prints.groupBy(*KEY, "b_us").agg(
        F.max("price").alias("hi"),
        F.min("price").alias("lo"),
        F.min(order).alias("_first"),
    )
    lv = buckets.select(*KEY, "b_us", "epoch", F.explode("levels").alias("lv")).select(
        *KEY,
        "b_us",
        "epoch",
        F.col("lv.kind").alias("kind"),
        F.col("lv.price").alias("level"),
        F.round("lv.price", 2).alias("cents"),
    )
    lived = lv.join(lifetimes(epochs), [*KEY, "epoch", *LEVEL_KEY], "left").withColumn(
        "life", F.coalesce("life", -1_000_000 - F.col("epoch"))
    )
    both = lived.join(ranges, [*KEY, "b_us"])
    # one side throughout: everything above, or nothing above (equal counts as below)
    above = F.col("lo") > F.col("level")
    below = F.col("hi") <= F.col("level")
    cols = [*KEY, *LEVEL_KEY, "life", "level"]
    quiet = both.filter(above | below).select(
        *cols,
        F.col("_first.ts_us").alias("ts_us"),
        F.col("_first.seq").alias("seq"),
        above.alias("above"),
        "hi",
        "lo",
        F.lit(None).cast("double").alias("price"),
    )
    crossed = both.filter(~(above | below)).select(*cols, "b_us")
    detail = crossed.join(prints.select(*KEY, "b_us", "ts_us", "seq", "price"), [*KEY, "b_us"])
    detail = detail.select(
        *cols,
        "ts_us",
        "seq",
        (F.col("price") > F.col("level")).alias("above"),
        F.col("price").alias("hi"),
        F.col("price").alias("lo"),
        "price",
    )
    return quiet.unionByName(detail)


def sweep_reclaims(obs: DataFrame, p: Profile) -> DataFrame:
    """Reclaim events (.., ts_us, seq, level, kind, direction, swept_extreme).

    Rows of one level between two crossings form an island; at a crossing the previous
    island's age and extreme decide.  A summary row can only end an island at its
    bucket's first print, whose position it carries."""
    part = [*KEY, *LEVEL_KEY, "life"]
    order = ["ts_us", "seq", "level"]
    rows = obs.withColumn("_chunk", floor_us(F.col("ts_us"), p.macro_us))
    prev = Running("_prev", "last", F.col("above"), inclusive=False)
    rows = running(rows, part, "_chunk", order, [prev])
    turned = F.coalesce(F.col("above") != F.col("_prev"), F.lit(False))
    rows = rows.withColumn("turn", turned)
    count = Running("island", "sum", F.col("turn").cast("bigint"))
    rows = running(rows, part, "_chunk", order, [count])
    islands = rows.groupBy(*part, "island").agg(
        F.min("ts_us").alias("since_us"),
        F.first("above").alias("was_above"),
        F.max("hi").alias("_hi"),
        F.min("lo").alias("_lo"),
    )
    islands = islands.select(
        *part,
        (F.col("island") + 1).alias("island"),
        "since_us",
        "was_above",
        F.when(F.col("was_above"), F.col("_hi")).otherwise(F.col("_lo")).alias("swept_extreme"),
    )
    back = rows.filter("turn").join(islands, [*part, "island"])
    excursion = F.abs(F.col("swept_extreme") - F.col("level")) / F.col("level") * 1e4
    short = (F.col("ts_us") - F.col("since_us")) <= p.us(p.sweep_window_s)
    return back.filter(short & (excursion <= p.sweep_max_bps)).select(
        *KEY,
        "ts_us",
        "seq",
        "level",
        "kind",
        F.when(F.col("was_above"), -1).otherwise(1).alias("direction"),
        "swept_extreme",
    )


def active_reclaims(prints: DataFrame, reclaims: DataFrame, p: Profile) -> DataFrame:
    """Reclaims still fresh at each print: all that are not older than ``reclaim_age_s``.

    Time is cut into slices of a quarter of that age, and each reclaim stands in its own slice
    and the next four.  A print then meets, on equality, all reclaims that can be fresh for it,
    each of them once and few others.  Prints with a ``direction`` meet only reclaims of it."""
    numbered = running(
        reclaims.withColumn("_chunk", floor_us(F.col("ts_us"), p.macro_us)),
        KEY,
        "_chunk",
        ["ts_us", "seq", "level", "kind"],
        [Running("r_idx", "sum", F.lit(1).cast("bigint"))],
    )
    age = p.us(p.reclaim_age_s)
    own = F.expr(f"ts_us div {max(1, -(-age // AGE_SLICES))}")
    by = [*KEY, "_age", *(["direction"] if "direction" in prints.columns else [])]
    events = numbered.select(
        *KEY,
        F.explode(F.sequence(own, own + AGE_SLICES)).alias("_age"),
        "r_idx",
        F.col("ts_us").alias("r_ts_us"),
        F.col("seq").alias("_r_seq"),
        F.col("level").alias("level_price"),
        F.col("kind").alias("level_kind"),
        "direction",
    )
    both = prints.withColumn("_age", own).join(events, by)
    before = (F.col("r_ts_us") < F.col("ts_us")) | (
        (F.col("r_ts_us") == F.col("ts_us")) & (F.col("_r_seq") <= F.col("seq"))
    )
    return both.filter(before & (F.col("ts_us") - F.col("r_ts_us") <= age)).drop("_age", "_r_seq")
