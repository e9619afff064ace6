"""Price levels: static, opening range, rolling ranges, swings, compression, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scan import asof_rows
from ..profile import Profile
from .bars import with_ema

KEY = ("symbol", "session")

# Level kinds, their merge priority (lower wins) and their side.
KINDS = {
    "PDH": 0, "PDL": 1, "PDC": 2, "PMH": 3, "PML": 4, "ORH": 5, "ORL": 6, "VWAP": 7,
    "RANGE_H": 8, "RANGE_L": 9, "MICRO_H": 10, "MICRO_L": 11, "SWING_H": 12, "SWING_L": 13,
    "SWING5_H": 14, "SWING5_L": 15,
}
PRIORITY = {
    "PDH": 0, "PDL": 0, "PDC": 1, "PMH": 1, "PML": 1, "ORH": 2, "ORL": 2, "VWAP": 3,
    "SWING5_H": 4, "SWING5_L": 4, "SWING_H": 5, "SWING_L": 5, "RANGE_H": 6, "RANGE_L": 6,
    "MICRO_H": 7, "MICRO_L": 7,
}
UPPER_KINDS = (0, 3, 5, 8, 10, 12, 14)
MAJOR_KINDS = (0, 1, 3, 4, 5, 6)
PIVOT_KINDS = (12, 13, 14, 15)
RANGE5_DEFAULT_BPS = 15.0  # fixed: five-bar range assumed before any is known

LEVEL = "struct<price:double,prio:int,kind:int>"


def level(price: Column, name: str) -> Column:
    return F.struct(
        price.cast("double").alias("price"),
        F.lit(PRIORITY[name]).alias("prio"),
        F.lit(KINDS[name]).alias("kind"),
    )


def _known(levels: Column) -> Column:
    return F.filter(levels, lambda x: F.coalesce(x["price"] > 0, F.lit(False)))


def _levels(*pairs: tuple[str, str]) -> Column:
    return _known(F.array(*[level(F.col(c), name) for c, name in pairs]))


def static_levels(prior: DataFrame, premarket: DataFrame) -> DataFrame:
    """Per (symbol, session): known prior-day and premarket levels as an array."""
    joined = prior.join(premarket, list(KEY), "full_outer")
    return joined.select(
        *KEY,
        _levels(("pdh", "PDH"), ("pdl", "PDL"), ("pdc", "PDC"), ("pmh", "PMH"), ("pml", "PML"))
        .alias("static"),
        "pmh",
        "pml",
    )


def range_levels(macro: DataFrame) -> DataFrame:
    """Ten- and three-bar extremes, and the five-bar range, as of each macro bar."""
    w = W.partitionBy(*KEY).orderBy("m_us")

    def hi(n: int) -> Column:
        return F.max("high").over(w.rowsBetween(1 - n, 0))

    def lo(n: int) -> Column:
        return F.min("low").over(w.rowsBetween(1 - n, 0))

    return macro.select(
        "*",
        hi(10).alias("range_h"),
        lo(10).alias("range_l"),
        hi(3).alias("micro_h"),
        lo(3).alias("micro_l"),
        (hi(5) - lo(5)).alias("range5m"),
    )


def with_pivots(macro: DataFrame) -> DataFrame:
    """Flag five-bar fractals (known only two bars later)."""
    w = W.partitionBy(*KEY).orderBy("m_us")

    def near(c: str, k: int) -> Column:
        return F.lag(c, k).over(w) if k > 0 else F.lead(c, -k).over(w)

    h, l = F.col("high"), F.col("low")
    up = (h >= near("high", 1)) & (h >= near("high", 2))
    up = up & (h > near("high", -1)) & (h > near("high", -2))
    dn = (l <= near("low", 1)) & (l <= near("low", 2))
    dn = dn & (l < near("low", -1)) & (l < near("low", -2))
    return macro.withColumn("pivot_h", F.coalesce(up, F.lit(False))).withColumn(
        "pivot_l", F.coalesce(dn, F.lit(False))
    )


def swing_levels(macro: DataFrame) -> DataFrame:
    """The last three confirmed pivots of either side within the last forty bars."""
    flagged = with_pivots(macro)
    frame = W.partitionBy(*KEY).orderBy("m_us").rowsBetween(-37, -2)

    def last3(flag: str, price: str) -> Column:
        seen = F.collect_list(F.when(F.col(flag), F.col(price))).over(frame)
        return F.slice(seen, F.greatest(F.size(seen) - 2, F.lit(1)), F.lit(3))

    return flagged.withColumns(
        {"swing_h": last3("pivot_h", "high"), "swing_l": last3("pivot_l", "low")}
    )


def swing5_levels(macro: DataFrame) -> DataFrame:
    """Fractals over chunks of five bars, counted from the start of the last forty."""
    frame = W.partitionBy(*KEY).orderBy("m_us").rowsBetween(-39, 0)
    rows = macro.withColumn("_a", F.collect_list(F.struct("high", "low")).over(frame)).withColumn(
        "_k", F.floor(F.size("_a") / 5).cast("int")
    )

    def chunk(i: Column, field: str) -> Column:
        vals = F.transform(F.slice("_a", i * 5 + 1, F.lit(5)), lambda x: x[field])
        return F.array_max(vals) if field == "high" else F.array_min(vals)

    chunks = F.transform(
        F.sequence(F.lit(0), F.col("_k") - 1),
        lambda i: F.struct(chunk(i, "high").alias("h"), chunk(i, "low").alias("l")),
    )
    none = F.array().cast("array<double>")
    rows = rows.withColumn("_c", F.when(F.col("_k") >= 3, chunks))

    def turn(field: str, sign: int) -> Column:
        def strict(i: Column) -> Column:
            mid = F.get("_c", i)[field] * sign
            return (mid > F.get("_c", i - 1)[field] * sign) & (
                mid > F.get("_c", i + 1)[field] * sign
            )

        at = F.filter(F.sequence(F.lit(1), F.col("_k") - 2), strict)
        vals = F.transform(at, lambda i: F.get("_c", i)[field])
        return F.coalesce(F.when(F.col("_k") >= 3, vals), none)

    return rows.withColumns({"swing5_h": turn("h", 1), "swing5_l": turn("l", -1)}).drop(
        "_a", "_k", "_c"
    )


def compression(macro: DataFrame, p: Profile) -> DataFrame:
    """Range contraction of the last three bars against up to ten before them, and the
    run of inside bars (capped by the thirteen-bar view)."""
    w = W.partitionBy(*KEY).orderBy("m_us")
    rng = F.col("high") - F.col("low")
    inside = (F.col("high") <= F.lag("high").over(w)) & (F.col("low") >= F.lag("low").over(w))
    rows = macro.withColumn("_in", F.coalesce(inside, F.lit(False))).withColumn(
        "_i", F.row_number().over(w)
    )
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    last_break = F.max(F.when(~F.col("_in"), F.col("_i"))).over(upto)
    avg3 = F.avg(rng).over(w.rowsBetween(-2, 0))
    prior = F.avg(rng).over(w.rowsBetween(-12, -3))
    enough = F.col("_i") >= 6
    ratio = F.when(enough & (prior > 0), avg3 / prior).otherwise(F.lit(1.0))
    # a view of thirteen bars holds at most twelve comparisons
    run = F.least(F.col("_i") - last_break, F.lit(12))
    return (
        rows.withColumn("comp_ratio", ratio)
        .withColumn("tightening", F.when(enough, run).otherwise(0).cast("bigint"))
        .withColumn("comp_active", enough & (F.col("comp_ratio") <= p.compression_max_ratio))
        .drop("_in", "_i")
    )


def macro_structure(macro: DataFrame, p: Profile, seeds: DataFrame | None = None) -> DataFrame:
    """Everything a completed macro bar publishes, one row per bar, numbered by epoch."""
    w = W.partitionBy(*KEY).orderBy("m_us")
    rows = with_ema(compression(swing5_levels(swing_levels(range_levels(macro))), p), seeds)
    n = p.trend_extreme_min

    def many(c: str, name: str) -> Column:
        return F.transform(F.col(c), lambda x: level(x, name))

    dynamic = F.concat(
        _levels(
            ("range_h", "RANGE_H"), ("range_l", "RANGE_L"),
            ("micro_h", "MICRO_H"), ("micro_l", "MICRO_L"),
        ),
        many("swing_h", "SWING_H"), many("swing_l", "SWING_L"),
        many("swing5_h", "SWING5_H"), many("swing5_l", "SWING5_L"),
    )
    five = w.rowsBetween(-4, 0)
    rng = F.col("high") - F.col("low")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    # a flat five-bar range leaves the previous width in force
    width = F.when(
        F.col("range5m") > 0, F.greatest(F.col("range5m") / F.col("close") * 1e4, F.lit(1.0))
    )
    return rows.select(
        *KEY,
        "m_us",
        "eff_us",
        "close",
        F.row_number().over(w).cast("bigint").alias("epoch"),
        dynamic.alias("dynamic"),
        "range5m",
        F.coalesce(F.last(width, ignorenulls=True).over(upto), F.lit(RANGE5_DEFAULT_BPS)).alias(
            "range5m_bps"
        ),
        "ema_change",
        F.when(F.count(F.lit(1)).over(five) >= 5, F.avg(rng).over(five)).alias("avg_range5"),
        "comp_ratio",
        "comp_active",
        F.max("high").over(w.rowsBetween(1 - n, 0)).alias("ext_hi"),
        F.min("low").over(w.rowsBetween(1 - n, 0)).alias("ext_lo"),
    )


def merge_levels(levels: Column, p: Profile) -> Column:
    """Collapse levels within ``merge_bps`` of the last kept one; better priority wins.

    The fold runs over at most a few dozen levels of one instant."""

    def step(acc: Column, lv: Column) -> Column:
        last = F.element_at(acc, -1)
        far = F.abs(lv["price"] - last["price"]) / last["price"] * 1e4 >= p.merge_bps
        return (
            F.when(F.size(acc) == 0, F.array(lv))
            .when(far, F.concat(acc, F.array(lv)))
            .when(
                lv["prio"] < last["prio"],
                F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(lv)),
            )
            .otherwise(acc)
        )

    return F.aggregate(F.array_sort(levels), F.array().cast(f"array<{LEVEL}>"), step)


STATE = ("epoch", "dynamic", "range5m_bps", "avg_range5", "comp_ratio", "comp_active", "ext_hi",
         "ext_lo", "ema_change")


def bucket_state(bars: DataFrame, structure: DataFrame) -> DataFrame:
    """Macro state visible at the start of each micro bucket (as-of on ``eff_us``)."""
    out = asof_rows(bars, structure, KEY, "b_us", "eff_us", STATE)
    return out.withColumns(
        {
            "epoch": F.coalesce("epoch", F.lit(0).cast("bigint")),
            "dynamic": F.coalesce("dynamic", F.array().cast(f"array<{LEVEL}>")),
            "range5m_bps": F.coalesce("range5m_bps", F.lit(RANGE5_DEFAULT_BPS)),
            "comp_ratio": F.coalesce("comp_ratio", F.lit(1.0)),
            "comp_active": F.coalesce("comp_active", F.lit(False)),
        }
    )


def _fixed(at: str) -> Column:
    """Static levels plus the opening range once it is locked at time ``at``."""
    none = F.array().cast(f"array<{LEVEL}>")
    locked = F.coalesce(F.col("or_eff_us") <= F.col(at), F.lit(False))
    opening = F.when(locked, _levels(("or_high", "ORH"), ("or_low", "ORL"))).otherwise(none)
    return F.concat(F.coalesce("static", none), opening)


def bucket_levels(
    state: DataFrame, static: DataFrame, opening: DataFrame, vwap0: DataFrame, p: Profile
) -> DataFrame:
    """Merged levels of every bucket that has a price-forming print.

    ``vwap0``: (symbol, session, b_us, vwap0), the VWAP at that bucket's first
    price-forming print; the bucket keeps its list, as levels refresh once per unit."""
    rows = (
        state.join(vwap0, [*KEY, "b_us"], "left")
        .join(static, list(KEY), "left")
        .join(opening, list(KEY), "left")
    )
    vwap = _levels(("vwap0", "VWAP"))
    everything = F.concat(_fixed("b_us"), F.col("dynamic"), vwap)
    return rows.withColumn("levels", merge_levels(everything, p)).drop(
        "static", "dynamic", "or_high", "or_low", "or_eff_us"
    )


def epoch_levels(
    structure: DataFrame, static: DataFrame, opening: DataFrame, p: Profile
) -> DataFrame:
    """Merged levels without VWAP at each epoch start; epoch 0 has the static ones only."""
    none = F.array().cast(f"array<{LEVEL}>")
    rows = structure.select(*KEY, "epoch", "eff_us", "dynamic")
    zero = structure.select(*KEY).distinct().select(
        *KEY,
        F.lit(0).cast("bigint").alias("epoch"),
        F.lit(0).cast("bigint").alias("eff_us"),
        none.alias("dynamic"),
    )
    rows = rows.unionByName(zero).join(static, list(KEY), "left").join(opening, list(KEY), "left")
    merged = merge_levels(F.concat(_fixed("eff_us"), F.col("dynamic")), p)
    return rows.select(*KEY, "epoch", F.explode(merged).alias("_l")).select(
        *KEY, "epoch", "_l.*"
    )


def trigger_verb(kind: Column, direction: Column, is_reclaim: Column) -> Column:
    """How an alert names the event: reclaim, cross, pivot, reject or break."""
    upper = kind.isin(*UPPER_KINDS)
    return (
        F.when(is_reclaim, "reclaim")
        .when(kind == KINDS["VWAP"], "cross")
        .when(kind.isin(*PIVOT_KINDS), "pivot")
        .when(kind == KINDS["PDC"], "cross")
        .when((upper & (direction < 0)) | (~upper & (direction > 0)), "reject")
        .otherwise("break")
    )


def nearest(levels: Column, price: Column, max_frac: float, side: int) -> Column:
    """The freshest crossed level: highest below (side 1) or lowest above (side -1)."""
    near = F.filter(
        levels,
        lambda lv: ((price - lv["price"]) * side > 0)
        & (F.abs(price - lv["price"]) <= price * max_frac),
    )
    return F.array_max(near) if side > 0 else F.array_min(near)
