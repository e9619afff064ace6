"""Market and fear proxies: velocities per bucket, read strictly before the bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.expr import bps, clamp
from ..functions.scan import asof_rows
from ..profile import Profile


def proxy_velocity(filled: DataFrame, symbol: str, p: Profile) -> DataFrame:
    """Velocities of one proxy after each of its bars: (session, eff_us, v_short, v_long).

    ``eff_us`` is the end of the bar, from when the values may be read."""
    w = W.partitionBy("session").orderBy("b_us")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    one = filled.filter(F.col("symbol") == symbol)

    def vel(k: int):
        # the reading happens inside the *next* bucket, k finalized bars back
        return clamp(
            bps(F.col("close"), F.lag("close", k - 1).over(w)) / k, -p.context_clamp, p.context_clamp
        )

    return one.select(
        "session",
        (F.col("b_us") + p.unit_us).alias("eff_us"),
        F.coalesce(vel(p.context_short), F.lit(0.0)).alias("v_short"),
        F.coalesce(vel(p.context_long), F.lit(0.0)).alias("v_long"),
        F.max("last_forming_us").over(upto).alias("seen_us"),
    )


def with_context(bars: DataFrame, filled: DataFrame, market: str, fear: str, p: Profile):
    """Add mkt_1m, mkt_5m, fear_1m, fear_5m (unaligned) to bar-level rows.

    Grid rows are unique per (session, bucket), so the as-of runs once per bucket and
    joins back on equality instead of once per print."""
    grid = bars.select("session", "b_us").distinct()
    for prefix, sym in (("mkt", market), ("fear", fear)):
        vel = proxy_velocity(filled, sym, p)
        grid = asof_rows(
            grid, vel, ["session"], "b_us", "eff_us", ["v_short", "v_long", "seen_us"]
        )
        fresh = (F.col("b_us") - F.col("seen_us")) <= p.us(p.context_stale)
        grid = grid.select(
            *[c for c in grid.columns if c not in ("v_short", "v_long", "seen_us")],
            F.when(fresh, F.col("v_short")).otherwise(F.lit(0.0)).alias(f"{prefix}_1m"),
            F.when(fresh, F.col("v_long")).otherwise(F.lit(0.0)).alias(f"{prefix}_5m"),
        )
    return bars.join(grid, ["session", "b_us"], "left")
