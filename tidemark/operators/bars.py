"""Micro bars, gap filling, macro bars and the rolling values read from them.

Print-level work is partitioned by (symbol, session, micro bucket).  Bar-level
windows are partitioned by (symbol, session): their rows are bounded by the session
length on the time grid, not by the number of prints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.expr import bps, floor_us, order_key, ratio
from ..functions.scan import ewma
from ..profile import Profile

KEY = ("symbol", "session")
FLOW = ("vol", "buy_vol", "sell_vol", "n")
EMA_ALPHA = 2.0 / 21.0  # fixed: twenty-bar exponential average
#: Decimals of a change of the average: flat closes change it by nothing, not by rounding noise,
#: whose sign would decide verdicts.
CHANGE_DECIMALS = 9


def _in_session() -> Column:
    return F.col("ts_us") >= F.col("open_us")


def bar_aggregates(at: str = "ts_us") -> list[Column]:
    """Aggregates of one bucket's prints, which go by ``at`` (event or arrival time), then seq."""
    order = order_key(F.col(at), F.col("seq"))
    forming = F.when(F.col("updates_last"), F.col("price"))
    flow = F.col("flow_eligible")
    size, worth = F.col("size"), F.col("price") * F.col("size")
    seen = flow & _in_session()

    def count(cond: Column, value: Column, zero) -> Column:
        return F.coalesce(F.sum(F.when(cond, value)), F.lit(zero))

    return [
        F.min_by("price", order).alias("_first"),
        F.min_by("updates_last", order).alias("_first_forming"),
        F.max(forming).alias("_hi"),
        F.min(forming).alias("_lo"),
        F.max_by("price", F.when(F.col("updates_last"), order)).alias("_last"),
        F.max(F.when(F.col("updates_last"), F.col("ts_us"))).alias("last_forming_us"),
        count(F.col("updates_volume"), size, 0).alias("vol"),
        count(flow & (F.col("side") > 0), size, 0).alias("buy_vol"),
        count(flow & (F.col("side") < 0), size, 0).alias("sell_vol"),
        F.count_if(flow).alias("n"),
        count(flow, worth, 0.0).alias("dollar"),
        count(seen, worth, 0.0).alias("s_pv"),
        count(seen, size, 0).alias("s_v"),
        F.max(F.when(_in_session(), forming)).alias("s_hi"),
        F.min(F.when(_in_session(), forming)).alias("s_lo"),
        F.first("open_us").alias("open_us"),
        F.first("close_us").alias("close_us"),
    ]


def finish_bars(agg: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """Open, high, low and close from the aggregates of all buckets of a session.

    A bucket opens at its first print when that print is price-forming, else at the
    last price-forming price so far (``last_price`` of the key's seeds before any); high and
    low include the open."""
    before = W.partitionBy(*KEY).orderBy("b_us").rowsBetween(W.unboundedPreceding, -1)
    prev = F.last("_last", ignorenulls=True).over(before)
    if seeds is not None:
        agg = agg.join(seeds.select(*KEY, F.col("last_price").alias("_seed")), list(KEY), "left")
        prev = F.coalesce(prev, "_seed")
    opened = F.when(F.col("_first_forming"), F.col("_first")).otherwise(
        F.coalesce(prev, F.col("_first"))
    )
    return agg.withColumn("open", opened).select(
        *KEY,
        "b_us",
        "open",
        F.greatest("open", "_hi").alias("high"),
        F.least("open", "_lo").alias("low"),
        F.coalesce("_last", "open").alias("close"),
        *FLOW,
        "dollar",
        "s_pv",
        "s_v",
        "s_hi",
        "s_lo",
        "last_forming_us",
        "open_us",
        "close_us",
        F.lit(False).alias("filled"),
    )


def micro_bars(prints: DataFrame, p: Profile, seeds: DataFrame | None = None) -> DataFrame:
    """One row per (symbol, session, unit) that has prints."""
    rows = prints.withColumn("b_us", floor_us(F.col("ts_us"), p.unit_us))
    return finish_bars(rows.groupBy(*KEY, "b_us").agg(*bar_aggregates()), seeds)


def arrival_bars(prints: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """Micro bars of prints that know their bucket (``ingest.rebucket_late``), by arrival."""
    return finish_bars(prints.groupBy(*KEY, "b_us").agg(*bar_aggregates("arr_us")), seeds)


def _flat(price: Column, b_us: Column, source: DataFrame) -> list[Column]:
    """Columns of a flat zero-volume bar, in the schema of ``source``."""
    zero = {"vol", "buy_vol", "sell_vol", "n", "s_v"}
    out = []
    for c in source.columns:
        if c == "b_us":
            out.append(b_us.alias(c))
        elif c in ("open", "high", "low", "close"):
            out.append(price.alias(c))
        elif c in zero:
            out.append(F.lit(0).cast("bigint").alias(c))
        elif c in ("dollar", "s_pv"):
            out.append(F.lit(0.0).alias(c))
        elif c in ("s_hi", "s_lo", "last_forming_us"):
            out.append(F.lit(None).cast(source.schema[c].dataType).alias(c))
        elif c == "filled":
            out.append(F.lit(True).alias(c))
        else:
            out.append(F.col(c))
    return out


def gap_fill(bars: DataFrame, p: Profile) -> DataFrame:
    """Flat zero-volume bars for the missing units between two bars of a session.

    A hole wider than ``gap_cap`` units gets a single filler just before its end, so
    the fan-out per bar is bounded."""
    nxt = F.lead("b_us").over(W.partitionBy(*KEY).orderBy("b_us"))
    u = p.unit_us
    holes = bars.withColumn("_next", nxt).filter(F.col("_next") > F.col("b_us") + u)
    first = F.when(
        F.col("_next") - F.col("b_us") > p.gap_cap * u, F.col("_next") - u
    ).otherwise(F.col("b_us") + u)
    fill = holes.withColumn("_f", F.explode(F.sequence(first, F.col("_next") - u, F.lit(u))))
    return bars.unionByName(fill.select(*_flat(F.col("close"), F.col("_f"), bars)))


def preopen_seed(bars: DataFrame, last_premarket: DataFrame, p: Profile, units: int = 60):
    """Flat bars for the ``units`` before the open where a session has no earlier bar.

    ``last_premarket``: (symbol, session, price, open_us, close_us)."""
    early = bars.filter(F.col("b_us") < F.col("open_us")).select(*KEY).distinct()
    need = last_premarket.filter(F.col("price") > 0).join(early, list(KEY), "left_anti")
    u = p.unit_us
    at = F.explode(F.sequence(F.col("open_us") - units * u, F.col("open_us") - u, F.lit(u)))
    return need.withColumn("_f", at).select(*_flat(F.col("price"), F.col("_f"), bars))


def macro_bars(filled: DataFrame, p: Profile) -> DataFrame:
    """Fold micro bars into macro bars; ``eff_us`` is when the bar may first be used."""
    return (
        filled.withColumn("m_us", floor_us(F.col("b_us"), p.macro_us))
        .groupBy(*KEY, "m_us")
        .agg(
            F.min_by("open", "b_us").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "b_us").alias("close"),
            *[F.sum(c).alias(c) for c in FLOW],
            F.sum("dollar").alias("dollar"),
            F.count_if(~F.col("filled")).alias("traded_units"),
            F.first("open_us").alias("open_us"),
            F.first("close_us").alias("close_us"),
        )
        .withColumn("eff_us", F.col("m_us") + p.visibility_us)
    )


def hist_to_minutes(hist: DataFrame, p: Profile) -> DataFrame:
    """Vendor bars in macro-bar shape: dollar volume from VWAP, else from the close."""
    px = F.when(F.col("vwap") > 0, F.col("vwap")).otherwise(F.col("close"))
    return hist.select(
        "symbol",
        floor_us(F.col("ts_us"), p.macro_us).alias("m_us"),
        "open",
        "high",
        "low",
        "close",
        F.col("volume").alias("vol"),
        F.col("trade_count").alias("n"),
        (px * F.col("volume")).alias("dollar"),
    )


# ------------------------------------------------------------------ bar-level windows


def with_bar_windows(
    filled: DataFrame,
    sums: Sequence[int] = (5, 15, 60),
    agos: Sequence[int] = (5, 15),
    ranges: Sequence[int] = (15,),
    seeds: DataFrame | None = None,
) -> DataFrame:
    """State just *before* each bucket: window sums, closes k bars ago, extremes, VWAP.

    ``seeds`` (see ``warmup.state_seeds``) are what the session had before its first bar.

    Sums over integers are differences of one prefix sum, so their cost does not grow
    with the window length."""
    w = W.partitionBy(*KEY).orderBy("b_us")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    out = filled.select(
        "*",
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_p_{c}") for c in FLOW],
        F.sum("s_pv").over(before).alias("c_pv"),
        F.sum("s_v").over(before).alias("c_v"),
        F.max("s_hi").over(before).alias("c_hi"),
        F.min("s_lo").over(before).alias("c_lo"),
    )
    out = out.select(
        *[c for c in out.columns if not c.startswith("_p_")],
        *[
            (F.col(f"_p_{c}") - F.coalesce(F.lag(f"_p_{c}", n - 1).over(w), F.lit(0))).alias(
                f"p_{c}{n}"
            )
            for n in sums
            for c in FLOW
        ],
        F.coalesce(F.sum("dollar").over(w.rowsBetween(-4, -1)), F.lit(0.0)).alias("p_dollar5"),
        *[F.lag("close", k).over(w).alias(f"ago{k}") for k in agos],
        *[F.max("high").over(w.rowsBetween(-k, -1)).alias(f"p_hi{k}") for k in ranges],
        *[F.min("low").over(w.rowsBetween(-k, -1)).alias(f"p_lo{k}") for k in ranges],
    )
    return out if seeds is None else _seeded(out, seeds)


def _seeded(rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """Cumulative session values with the seeds of their key."""
    names = ("seed_pv", "seed_v", "seed_hi", "seed_lo")
    both = rows.join(seeds.select(*KEY, *names), list(KEY), "left")
    known = F.col("seed_v").isNotNull()
    return both.withColumns(
        {
            "c_pv": F.when(known, F.col("seed_pv") + F.coalesce("c_pv", F.lit(0.0))).otherwise(F.col("c_pv")),
            "c_v": F.when(known, F.col("seed_v") + F.coalesce("c_v", F.lit(0))).otherwise(F.col("c_v")),
            "c_hi": F.greatest("c_hi", "seed_hi"),
            "c_lo": F.least("c_lo", "seed_lo"),
        }
    ).drop(*names)


# Columns of the bar a print falls into that would look ahead of the print.
BAR_ONLY = (
    "high", "low", "close", "vol", "buy_vol", "sell_vol", "n", "dollar", "s_pv", "s_v",
    "s_hi", "s_lo", "last_forming_us", "filled", "open_us", "close_us",
)


def print_windows(
    prints: DataFrame, bars: DataFrame, p: Profile, sums: Sequence[int] = (5, 15, 60)
) -> DataFrame:
    """Rolling values at every print: finalized bars plus the running current bucket.

    ``bars`` comes from :func:`with_bar_windows` (and may carry more bar-level columns,
    which are passed through).  Nothing after the print's own position is read."""
    rows = prints.withColumn("b_us", floor_us(F.col("ts_us"), p.unit_us))
    run = (
        W.partitionBy(*KEY, "b_us")
        .orderBy("ts_us", "seq")
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    flow, size, price = F.col("flow_eligible"), F.col("size"), F.col("price")
    forming = F.when(F.col("updates_last"), price)
    seen = flow & _in_session()

    def total(cond: Column, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, value)).over(run), F.lit(0))

    local = rows.select(
        "*",
        total(F.col("updates_volume"), size).alias("q_vol"),
        total(flow & (F.col("side") > 0), size).alias("q_buy_vol"),
        total(flow & (F.col("side") < 0), size).alias("q_sell_vol"),
        total(flow, F.lit(1)).alias("q_n"),
        total(flow, price * size).alias("q_dollar"),
        total(seen, price * size).alias("q_pv"),
        total(seen, size).alias("q_v"),
        F.max(forming).over(run).alias("q_hi"),
        F.min(forming).over(run).alias("q_lo"),
        F.max(F.when(_in_session(), forming)).over(run).alias("q_shi"),
        F.min(F.when(_in_session(), forming)).over(run).alias("q_slo"),
        F.last(forming, ignorenulls=True).over(run).alias("q_last"),
    )
    state = bars.withColumnRenamed("open", "bar_open").drop(*BAR_ONLY)
    joined = local.join(state, [*KEY, "b_us"], "left")
    out = joined
    short = {"vol": "v", "buy_vol": "b", "sell_vol": "s", "n": "n"}
    cols = {
        f"{short[c]}{n}": F.col(f"p_{c}{n}") + F.col(f"q_{c}") for n in sums for c in FLOW
    }
    cols["dollar5"] = F.col("p_dollar5") + F.col("q_dollar")
    cum_pv = F.coalesce("c_pv", F.lit(0.0)) + F.col("q_pv")
    cum_v = F.coalesce("c_v", F.lit(0)) + F.col("q_v")
    cols["vwap"] = ratio(cum_pv, cum_v)
    cols["session_high"] = F.greatest("c_hi", "q_shi")
    cols["session_low"] = F.least("c_lo", "q_slo")
    for c in bars.columns:
        if c.startswith("p_hi"):
            k = c[4:]
            live = F.col("q_n") > 0
            part_hi = F.when(live, F.greatest("bar_open", "q_hi"))
            part_lo = F.when(live, F.least("bar_open", "q_lo"))
            cols[f"hi{k}"] = F.greatest(F.col(c), part_hi)
            cols[f"lo{k}"] = F.least(F.col(f"p_lo{k}"), part_lo)
    out = out.withColumns(cols)
    return out.drop(*[c for c in out.columns if c[:2] in ("p_", "q_", "c_") and c != "c_v"], "c_v")


# ------------------------------------------------------------------ macro-level windows


def with_ema(macro: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """EMA of macro closes and its change over three bars (null before four values).

    With ``seeds`` the average goes on from their ``ema``, whose last values are ``ema_tail``."""
    rows, close = macro.filter(F.col("close") > 0), F.col("close")
    w = W.partitionBy(*KEY).orderBy("m_us")
    ago = F.lag("ema20", 3).over(w)
    if seeds is None:
        out = ewma(rows, KEY, "m_us", close, EMA_ALPHA, "ema20")
        return out.withColumn("ema_change", F.round(F.col("ema20") - ago, CHANGE_DECIMALS))
    initial = seeds.select(*KEY, F.col("ema").alias("ema20"))
    out = ewma(rows, KEY, "m_us", close, EMA_ALPHA, "ema20", initial)
    out = out.join(seeds.select(*KEY, F.col("ema_tail").alias("_tail")), list(KEY), "left")
    # bar i (from 1) looks three values back, so the first three look into the tail
    at = F.row_number().over(w)
    earlier = F.when((at <= 3) & (F.size("_tail") + at >= 4), F.get("_tail", F.size("_tail") + at - 4))
    change = F.round(F.col("ema20") - F.coalesce(ago, earlier), CHANGE_DECIMALS)
    return out.withColumn("ema_change", change).drop("_tail")


def with_ema_slope(macro: DataFrame) -> DataFrame:
    """Slope in bps of the bar's own close."""
    out = with_ema(macro)
    return out.withColumn("ema_slope", F.col("ema_change") / F.col("close") * 1e4)


def velocity(price: Column, ago: Column, units: int) -> Column:
    """Signed bps per unit; 0 when the earlier price is unknown."""
    return F.coalesce(bps(price, ago) / units, F.lit(0.0))
