"""Trade-side classification against the latest quote, else the tick rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import floor_us, order_key
from ..functions.scan import Running, running
from ..profile import Profile

QUOTE_FIELDS = ("bid", "bid_size", "ask", "ask_size")


def valid_quotes(quotes: DataFrame) -> DataFrame:
    return quotes.filter((F.col("bid") > 0) & (F.col("ask") >= F.col("bid")))


def asof_quote(
    trades: DataFrame,
    quotes: DataFrame,
    p: Profile,
    see_equal_ts: bool = False,
    seeds: DataFrame | None = None,
) -> DataFrame:
    """Attach the latest valid quote and the previous flow price to every print.

    Trades and quotes of one (symbol, session, macro bucket) meet in one task; what
    was known before the bucket arrives as a carry row.  A quote with the print's own
    timestamp is visible only if ``see_equal_ts``.  The flow price before the first print is
    ``last_price`` of the key's seeds."""
    t = trades.select(
        *trades.columns,
        F.lit(1 if see_equal_ts else 0).alias("_prio"),
        F.lit(True).alias("_trade"),
    )
    q = valid_quotes(quotes).select(
        "symbol",
        "session",
        "ts_us",
        "seq",
        "bid",
        F.coalesce("bid_size", F.lit(0)).alias("bid_size"),
        "ask",
        F.coalesce("ask_size", F.lit(0)).alias("ask_size"),
        F.lit(0 if see_equal_ts else 1).alias("_prio"),
        F.lit(False).alias("_trade"),
    )
    both = t.unionByName(q, allowMissingColumns=True).withColumn(
        "_chunk", floor_us(F.col("ts_us"), p.macro_us)
    )
    flow_price = F.when(F.col("flow_eligible"), F.col("price"))
    seen = running(
        both,
        ["symbol", "session"],
        "_chunk",
        ["ts_us", "_prio", "seq"],
        [
            # all four are set on every valid quote, so their latest values belong together
            *[Running(f"q_{f}", "last", F.col(f)) for f in QUOTE_FIELDS],
            Running("prev_flow", "last", flow_price, inclusive=False),
        ],
        order_key(F.col("ts_us") * 4 + F.col("_prio"), F.col("seq")),
        None if seeds is None else seeds.select("symbol", "session", F.col("last_price").alias("prev_flow")),
    )
    quote = F.struct(*[F.col(f"q_{f}").alias(f) for f in QUOTE_FIELDS])
    return seen.filter("_trade").select(
        *trades.columns, F.when(F.col("q_bid").isNotNull(), quote).alias("quote"), "prev_flow"
    )


def with_side(joined: DataFrame) -> DataFrame:
    """+1 buyer-initiated, -1 seller-initiated, 0 unknown; 0 for non-flow prints."""
    price, bid, ask = F.col("price"), F.col("quote.bid"), F.col("quote.ask")
    mid = (ask + bid) * 0.5
    side = (
        F.when(~F.col("flow_eligible"), 0)
        .when(price >= ask, 1)
        .when(price <= bid, -1)
        .when(price > mid, 1)
        .when(price < mid, -1)
        .when(price > F.col("prev_flow"), 1)
        .when(price < F.col("prev_flow"), -1)
        .otherwise(0)
    )
    return joined.withColumn("side", side)


def classify_sides(
    trades: DataFrame, quotes: DataFrame, p: Profile, seeds: DataFrame | None = None
) -> DataFrame:
    return with_side(asof_quote(trades, quotes, p, seeds=seeds))
