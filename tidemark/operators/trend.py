"""Sustained one-sided pressure, evaluated once per micro bar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.expr import ratio
from ..profile import Profile
from .baseline import macro_idx
from .levels import KINDS


def trend_onset(bars: DataFrame, static: DataFrame, p: Profile) -> DataFrame:
    """Bars at whose end a trend onset holds.

    ``bars``: bar windows plus macro state and baseline (see plans.pipeline.bar_state).
    The tick at the end of a bar sees that bar and the macro state known at its start."""
    c = F.col
    w = W.partitionBy("symbol", "session").orderBy("b_us")
    tick = c("b_us") + p.unit_us
    rows = bars.join(static.select("symbol", "session", "pmh", "pml"), ["symbol", "session"], "left")
    rows = rows.withColumns(
        {
            "ts_us": tick,
            "price": c("close"),
            "ago": F.lag("close", p.trend_window_s).over(w),
            "v60": c("p_vol60") + c("vol"),
            "b60": c("p_buy_vol60") + c("buy_vol"),
            "s60": c("p_sell_vol60") + c("sell_vol"),
        }
    ).filter(tick >= c("open_us") + p.us(p.trend_window_s))
    move = (c("price") - c("ago")) / c("ago") * 1e4
    rows = rows.withColumn("move_bps", move).filter(F.abs(move) >= p.trend_min_bps)
    up = c("move_bps") > 0
    share = ratio(F.when(up, c("b60")).otherwise(c("s60")), c("b60") + c("s60"))
    young = c("epoch") < p.trend_extreme_min
    anchored = (c("epoch") >= p.trend_young_min) & (
        c("pmh").isNotNull() | c("pml").isNotNull()
    )
    hi = F.when(young, F.greatest("ext_hi", "pmh")).otherwise(c("ext_hi"))
    lo = F.when(young, F.least("ext_lo", "pml")).otherwise(c("ext_lo"))
    rows = rows.withColumns(
        {
            "direction": F.when(up, 1).otherwise(-1),
            "share": share,
            "level_price": F.when(up, hi).otherwise(lo),
            "level_kind": F.when(up, KINDS["RANGE_H"]).otherwise(KINDS["RANGE_L"]),
            "idx": macro_idx(tick, c("open_us"), p),
        }
    )
    enough = (c("base_vol") <= 0) | (c("v60") >= p.trend_vol_base_min * c("base_vol"))
    fresh = F.when(up, c("price") > c("level_price")).otherwise(c("price") < c("level_price"))
    return rows.filter(
        (c("share") >= p.trend_dir_share_min) & enough & (~young | anchored) & fresh
    ).withColumn("vol_ratio", F.coalesce(ratio(c("v60"), c("base_vol")), F.lit(0.0)))
