"""Score, penalty, the ordered gate chain and what a fired candidate carries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clamp, r_many
from ..profile import Profile

# Weights of the trigger score.
SCORE_WEIGHTS = {
    "vol_prev": 0.25, "vol_base": 0.15, "imb": 0.20, "vel": 0.20, "fresh": 0.10,
    "range_exp": 0.05, "comp": 0.05,
}


def _top(x: Column, top: float = 1.0) -> Column:
    return F.least(x, F.lit(top))


def score_parts(p: Profile) -> dict[str, Column]:
    """What the trigger score adds up before and after the distance from the level."""
    c, w = F.col, SCORE_WEIGHTS
    vol = _top(c("vol_ratio_prev") / (2.0 * p.vol_accel_min))
    base_scale = 2.0 * max(0.5, p.vol_accel_min * 0.75)
    base = F.when(c("vol_ratio_base") > 0, _top(c("vol_ratio_base") / base_scale)).otherwise(vol)
    imb = _top(F.abs(c("imb5")) / 0.6)
    vel = _top(c("vel5") * c("direction") / (3.0 * p.vel_min_bps_s))
    rng = _top(c("range_exp") / 3.0)
    comp = 1.0 - _top(c("comp_ratio"), 1.5) / 1.5
    flow = (
        w["vol_prev"] * vol
        + w["vol_base"] * base
        + w["imb"] * imb
        + w["vel"] * F.greatest(vel, F.lit(0.0))
    )
    return {
        "score_flow": flow,
        "score_range": w["range_exp"] * rng,
        "score_comp": w["comp"] * F.greatest(comp, F.lit(0.0)),
    }


def score(p: Profile) -> Column:
    """Trigger quality in 0..1, from its parts; every component saturates."""
    c = F.col
    fresh = 1.0 - _top(c("break_bps") / max(p.break_max_bps, 1.0))
    total = c("score_flow") + SCORE_WEIGHTS["fresh"] * fresh + c("score_range") + c("score_comp")
    return clamp(total, 0.0, 1.0)


def penalty(p: Profile) -> Column:
    """Evidence that the move is already chased; zero on a fresh volume explosion."""
    c = F.col
    if not p.fresh_break_veto:
        return F.lit(0.0)
    damp = 1.0 - c("vol_ratio_prev") / max(p.fresh_break_vol_max, 1e-9)
    stale_range = _top(F.greatest(c("comp_ratio") - p.comp_veto_ratio, F.lit(0.0)) / 0.5)
    one_sided = c("imb15") * c("direction") - p.imb15_blowoff_max
    stale_tape = _top(F.greatest(one_sided, F.lit(0.0)) / 0.25)
    hit = p.fake_start_weight * damp * F.greatest(stale_range, stale_tape)
    return F.when(damp <= 0, F.lit(0.0)).otherwise(hit)


def opening_phase(p: Profile) -> Column:
    return F.col("minute_frac") * float(p.session_macros) < p.open_phase_min


def threshold(p: Profile, score_mult: float = 1.0) -> Column:
    relax = F.when(F.col("comp_active"), F.lit(p.compression_relax)).otherwise(F.lit(1.0))
    return F.greatest(F.lit(p.score_floor), p.score_min * score_mult * relax)


def way_reason(p: Profile, vol_mult: float = 1.0) -> Column:
    """First failing gate of those that look at no level; null where none fails."""
    c = F.col
    d = c("direction")
    tired = c("vol_ratio_prev") < p.fresh_break_vol_max
    weak_base = (c("vol_ratio_base") > 0) & (c("vol_ratio_base") < p.vol_base_min)
    return (
        F.when(c("vel5") * d < p.vel_min_bps_s, "velocity")
        .when(~c("accelerating"), "not_accelerating")
        .when(c("vel15") * d > p.vel15_max_bps_s, "late_chase")
        .when((c("range_exp") > p.range_exp_max) & tired, "late_chase")
        .when(c("vol_ratio_prev") < p.vol_accel_min * vol_mult, "volume_accel")
        .when(weak_base, "volume_baseline")
        .when(c("imb5") * d < p.imb_min, "imbalance")
        .when(c("imb15") * d < p.imb15_min, "imbalance_15s")
        .when(c("n2s") < p.min_trades_2s, "single_print")
        .when(c("dominant_frac") > p.single_print_max_frac, "single_print")
        .when(c("persist_trades") < p.persist_min_trades, "persistence_count")
        .when(c("persist_span") < p.persist_min_span_s, "persistence_span")
    )


def gate_reason(p: Profile, way: Column, score_mult: float = 1.0) -> Column:
    """First failing gate in rule order, ``way`` being that of the print; null means a pass.

    'untriggered' candidates are not beyond their level yet and count as no rejection."""
    c = F.col
    need = threshold(p, score_mult)
    return (
        F.when(c("break_bps") < p.break_min_bps, "untriggered")
        .when(c("break_bps") > c("break_cap"), "extended")
        .when(way.isNotNull(), way)
        .when(
            c("score") - c("penalty") < need,
            F.when(c("score") >= need, "fake_start").otherwise("score"),
        )
    )


def risk_bps(p: Profile) -> Column:
    """Distance at which a setup is wrong, by the recent five-bar range."""
    c = F.col
    rng = F.when(
        opening_phase(p), F.greatest(c("range5m_bps"), F.lit(p.open_range_floor_bps))
    ).otherwise(c("range5m_bps"))
    return clamp(p.invalidation_range_frac * rng, p.invalidation_min_bps, p.invalidation_max_bps)


def invalidation(dist: Column) -> Column:
    """Price at which the setup is wrong."""
    return r_many(F.col("level_price") * (1.0 - F.col("direction") * dist / 1e4), 4)


def by_way(ways: DataFrame, p: Profile) -> DataFrame:
    """Add to oriented prints what score and gates need and no level changes."""
    cap = F.when(opening_phase(p), F.lit(p.break_max_open_bps)).otherwise(F.lit(p.break_max_bps))
    return ways.withColumns(
        score_parts(p)
        | {
            "penalty": penalty(p),
            "break_cap": cap,
            "risk_bps": risk_bps(p),
            "way_reason": way_reason(p),
            "loose_reason": way_reason(p, p.bound_low),
        }
    )


def evaluate(snaps: DataFrame, p: Profile) -> DataFrame:
    """Add score, gate_reason (inert multipliers) and invalidation to snapshots of ``by_way`` rows."""
    return (
        snaps.withColumn("score", score(p))
        .withColumn("gate_reason", gate_reason(p, F.col("way_reason")))
        .withColumn("invalidation", invalidation(F.col("risk_bps")))
    )


def signal_id(symbol: Column, ts_us: Column, direction: Column) -> Column:
    way = F.when(direction > 0, "U").otherwise("D")
    return F.concat_ws("-", symbol.cast("string"), F.floor(ts_us / 1000).cast("string"), way)


def rejection_counts(evaluated: DataFrame) -> DataFrame:
    """Rejections per symbol and reason (an upper bound: cooldowns are not applied)."""
    counted = evaluated.filter(
        F.col("gate_reason").isNotNull() & (F.col("gate_reason") != "untriggered")
    )
    return counted.groupBy("symbol", F.col("gate_reason").alias("reason")).agg(
        F.count("*").alias("rejections")
    )
