"""Signal-shaped facts over the orders table (column mappings only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timefn import ntz_us
from ..profile import SECOND_US
from .views import table

OPEN_S, CLOSE_S = 52_200, 75_600  # 14:30 and 21:00 UTC


def order_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One signal per order, alerted at a pseudo-random second of its day's session."""
    c = F.col
    o = table(spark, sf_dir, "orders").withColumn("day_us", ntz_us(c("o_orderdate")))
    second = (c("o_orderkey") * 7919) % (CLOSE_S - OPEN_S)
    status = (
        F.when(c("o_orderstatus") == "F", "CONFIRMED")
        .when(c("o_orderstatus") == "O", "FAILED")
        .otherwise("")
    )
    price = c("o_totalprice")
    json = F.concat(
        F.lit('{"score":'), (c("o_orderkey") % 100 / 100).cast("string"), F.lit(',"vol":'),
        (c("o_orderkey") % 7).cast("string"), F.lit("}"),
    )
    return o.select(
        c("o_orderkey").alias("signal_id"),
        c("o_custkey").alias("symbol"),
        F.when(c("o_orderkey") % 2 == 0, 1).otherwise(-1).alias("direction"),
        c("day_us"),
        (c("day_us") + OPEN_S * SECOND_US).alias("open_us"),
        (c("day_us") + CLOSE_S * SECOND_US).alias("close_us"),
        (c("day_us") + (second + OPEN_S) * SECOND_US).alias("alert_us"),
        price.alias("alert_price"),
        F.substring("o_orderpriority", 3, 20).alias("verb"),
        status.alias("resolution"),
        F.when(status != "", c("day_us") + (second + OPEN_S + 60) * SECOND_US).alias(
            "resolution_us"
        ),
        F.when(c("o_orderkey") % 5 == 0, 0.0).otherwise(price + 1).alias("resolution_price"),
        (c("o_orderkey") % 11 == 0).alias("suppressed"),
        F.when(status != "", price > 250_000).alias("label"),
        (c("o_orderkey") % 3 == 0).alias("was_late"),
        # a damaged document every seventeenth order
        F.when(c("o_orderkey") % 17 == 0, F.lit('{"score":')).otherwise(json).alias("features_json"),
    )
