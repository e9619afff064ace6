"""Arbitration without a task a session: every symbol alone first, then what symbols share.

Two things only tie the symbols of a session together: the shared alert budget, and adaptive
multipliers, which wait for ``min_labels`` outcomes.  So:

1. ``accepted``: the sequence each (session, symbol) has on its own.  After an alert nothing is
   looked at until its cooldown and gap are over, so the sequence jumps from one acceptance
   straight to the next acceptable candidate (binary search for the instant, then the first one
   of another structure); a few numbers are carried from batch to batch.
2. ``entangled``: a window over the accepted rows (a handful a symbol) tells in which sessions
   the budget would have refused one of them, or enough outcomes gather to wake the multipliers.
   Up to the first refusal both ways agree, so where there is none they agree throughout.
3. Entangled sessions, and only they, go through the sequential fold of ``arbiter``.
4. ``dispositions``: what became of every candidate, from the state that the latest acceptance
   before it left behind, found by a chunked as-of scan."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.expr import floor_us
from ..functions.scan import Running, running
from ..profile import Profile
from . import arbiter

GROUP = ("run_id", "session", "symbol")
ORDER = ("ts_us", "seq", "pref")
NEVER = (1 << 63) - 1
STATE = ("a_dir", "a_level", "a_deaf_us", "a_gap_us", "a_alerts", "a_trends")
ACCEPTED = (
    "run_id string, session bigint, symbol string, ts_us bigint, seq bigint, pref bigint, "
    "hidden boolean, ready boolean, a_dir int, a_level double, a_deaf_us bigint, a_gap_us bigint, "
    "a_alerts int, a_trends int"
)


def shortfall(p: Profile) -> Column:
    """Why a candidate is not good enough at multipliers of one; null if it is."""
    c = F.col
    relax = F.when(c("comp_active"), p.compression_relax).otherwise(1.0)
    need = F.greatest(F.lit(p.score_floor), p.score_min * relax)
    burst = (
        F.when(c("vol_ratio_prev") < p.vol_accel_min, "volume_accel")
        .when(c("score") - c("penalty") >= need, F.lit(None))
        .when(c("score") < need, "score")
        .otherwise("fake_start")
    )
    return F.when(~c("is_trend"), burst)


def suppressed(p: Profile) -> Column:
    """A high score passes whatever the models say; trends answer to the efficacy model only."""
    c = F.col
    weak = F.coalesce(c("efficacy_prob") < p.efficacy_prob_gate_min, F.lit(False))
    short = F.coalesce(~c("is_trend") & (c("prob") < p.prob_gate_min), F.lit(False))
    return F.coalesce(c("score") < p.prob_bypass_score, F.lit(False)) & (weak | short)


def free_us(p: Profile, hidden: Column) -> Column:
    """When a symbol looks at candidates again after this one was accepted."""
    c = F.col
    wait = (
        F.when(hidden, p.us(p.cooldown_suppressed_s))
        .when(c("resolution") == "CONFIRMED", p.us(p.cooldown_confirmed_s))
        .otherwise(p.us(p.cooldown_failed_s))
    )
    return F.coalesce(c("resolution_us") + wait, F.lit(NEVER))


@dataclass
class _Jumper:
    """One symbol's day: from one acceptance to the next."""

    p: Profile
    until: int = -NEVER
    direction: int = 0
    level: float = 0.0
    alerts: int = 0
    trends: int = 0
    out: list = field(default_factory=list)

    def next(self, ts, direction, level, trend, lo: int) -> int:
        """The first acceptable candidate from ``lo`` on, or the number of candidates."""
        lo = max(lo, int(np.searchsorted(ts, self.until, "left")))
        step = 256
        while lo < len(ts):
            part = slice(lo, lo + step)
            free = ~trend[part] if self.trends >= self.p.trend_max_per_day else np.ones(len(ts[part]), bool)
            if self.level > 0:
                near = np.abs(level[part] - self.level) / self.level * 1e4 < self.p.re_arm_bps
                free &= ~((direction[part] == self.direction) & near)
            if free.any():
                return lo + int(free.argmax())
            lo, step = lo + step, step * 4
        return len(ts)

    def run(self, ts, direction, level, trend, hidden, free_at) -> list[int]:
        """Places accepted in these candidates, which follow those of earlier calls."""
        p, at, places = self.p, 0, []
        while self.alerts < p.max_alerts_symbol_day:
            at = self.next(ts, direction, level, trend, at)
            if at >= len(ts):
                break
            places.append(at)
            self.direction, self.level = int(direction[at]), float(level[at])
            self.trends += bool(trend[at])
            self.alerts += not hidden[at]
            gap = int(ts[at]) + p.us(p.min_gap_same_symbol_s)
            self.until = max(int(free_at[at]), gap)
            origin = (self.direction, self.level) if self.level > 0 else (None, None)
            self.out.append((*origin, int(free_at[at]), gap, self.alerts, self.trends))
            at += 1
        return places


def accepted(rows: DataFrame, p: Profile) -> DataFrame:
    """Acceptances of each (run, session, symbol) on its own, with the state each leaves."""
    hidden = suppressed(p)
    names = ["direction", "level_price", "is_trend", "hidden", "free_us"]
    good = rows.filter(shortfall(p).isNull()).select(
        *GROUP, *ORDER, F.coalesce("ready", F.lit(False)).alias("ready"), "direction", "level_price",
        "is_trend", hidden.alias("hidden"), free_us(p, hidden).alias("free_us"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, symbol = None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = list(zip(*(batch.column(c).to_pylist() for c in GROUP), strict=True))
            ts = np.asarray(batch.column("ts_us"))
            direction, level, trend, hidden_, free = (batch.column(c).to_numpy(zero_copy_only=False) for c in names)
            cuts = [0, *(i for i in range(1, n) if keys[i] != keys[i - 1]), n]
            places, states = [], []
            for i, j in zip(cuts, cuts[1:], strict=False):
                if keys[i] != key:
                    key, symbol = keys[i], _Jumper(p)
                found = symbol.run(ts[i:j], direction[i:j], level[i:j], trend[i:j].astype(bool), hidden_[i:j].astype(bool), free[i:j])
                places += [i + k for k in found]
                states += symbol.out
                symbol.out = []
            kept = batch.take(pa.array(places, pa.int64()))
            kinds = (pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            columns = [pa.array(c, k) for c, k in zip(zip(*states, strict=True) if states else [()] * 6, kinds, strict=True)]
            first = [*GROUP, *ORDER, "hidden", "ready"]
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in first), *columns], [*first, *STATE])

    ordered = good.repartition(*GROUP).sortWithinPartitions(*GROUP, *ORDER)
    return ordered.mapInArrow(run, ACCEPTED)


def entangled(won: DataFrame, p: Profile, carry: bool = False, adapt: bool = True) -> DataFrame:
    """Keys of the groups in which symbols influence each other: (run_id, session), or (run_id)
    where learning carries over sessions."""
    group = ["run_id"] if carry else ["run_id", "session"]
    signal = (~F.col("hidden")).cast("int")
    day = W.partitionBy("run_id", "session").orderBy("ts_us")
    binds = F.lit(False)
    for n, span in ((p.max_alerts_hour_total, p.us(p.hour_window_s)), (p.max_alerts_burst, p.us(p.burst_window_s))):
        # alerts of the same instant count whichever comes first: too careful, never too lax
        binds = binds | (F.sum(signal).over(day.rangeBetween(-span, 0)) - signal >= n)
    marked = won.withColumn("_binds", binds)
    out = marked.groupBy(*group).agg(F.max("_binds").alias("_binds"), F.count_if("ready").alias("_labels"))
    wakes = (F.col("_labels") >= p.min_labels) if adapt else F.lit(False)
    return out.filter(F.col("_binds") | wakes).select(*group)


def after_latest(rows: DataFrame, won: DataFrame, p: Profile, inclusive: bool = False) -> DataFrame:
    """Rows with the state that the latest acceptance of their symbol left (nulls before any).

    A row does not see its own acceptance, unless ``inclusive``."""
    side = F.col("_side")
    marks = won.select(*GROUP, *ORDER, F.struct(*STATE).alias("_a"), F.lit(0 if inclusive else 1).alias("_side"))
    both = rows.withColumn("_side", F.lit(1 if inclusive else 0)).unionByName(marks, allowMissingColumns=True)
    both = both.withColumns({"_chunk": floor_us(F.col("ts_us"), p.macro_us), "_row": side == (1 if inclusive else 0)})
    out = running(both, GROUP, "_chunk", [*ORDER, "_side"], [Running("_last", "last", F.col("_a"))])
    return out.filter("_row").select(*rows.columns, *[F.col(f"_last.{c}").alias(c) for c in STATE])


def ignored(p: Profile) -> Column:
    """Why a row is not looked at after the latest acceptance: ``cooldown``, ``re_arm`` or null."""
    c = F.col
    near = (c("direction") == c("a_dir")) & (F.abs(c("level_price") - c("a_level")) / c("a_level") * 1e4 < p.re_arm_bps)
    return F.when(c("ts_us") < c("a_deaf_us"), "cooldown").when(near, "re_arm")


def dispositions(rows: DataFrame, won: DataFrame, p: Profile) -> DataFrame:
    """Every candidate with what became of it: SIGNAL, SUPPRESSED, what it fell short of, a cap,
    ``cooldown``, ``re_arm`` or ``gap``.  Holds for sessions that are not entangled."""
    c = F.col
    seen = after_latest(rows, won, p)
    capped = F.when(
        c("is_trend") & (F.coalesce("a_trends", F.lit(0)) >= p.trend_max_per_day), "trend_day_cap"
    ).when(F.coalesce("a_alerts", F.lit(0)) >= p.max_alerts_symbol_day, "symbol_day_cap")
    gap = F.when(c("ts_us") < c("a_gap_us"), "gap")
    taken = F.when(suppressed(p), "SUPPRESSED").otherwise("SIGNAL")
    out = F.coalesce(ignored(p), shortfall(p), capped, gap, taken)
    return seen.withColumn("disposition", out).drop(*STATE)


SILENT = ("cooldown", "re_arm", "gap")


def arbitrate(
    rows: DataFrame,
    p: Profile,
    carry: bool = False,
    adapt: bool = True,
    verdicts: bool = True,
    stage: Callable[[DataFrame, str], DataFrame] = lambda df, name: df,
) -> DataFrame:
    """As ``arbiter.arbitrate`` over whole sessions; with ``verdicts`` off only what was accepted.

    ``stage`` may write the accepted rows, which are read a few times."""
    won = stage(accepted(rows, p), "accepted")
    group = ["run_id"] if carry else ["run_id", "session"]
    tied = stage(entangled(won, p, carry, adapt), "entangled")
    if verdicts:
        told = dispositions(rows.join(tied, group, "left_anti"), won, p)
        told = told.filter(~F.col("disposition").isin(*SILENT)).withColumn("verdict", F.col("disposition"))
    else:
        alone = won.join(tied, group, "left_anti")
        told = alone.withColumn("verdict", F.when(F.col("hidden"), "SUPPRESSED").otherwise("SIGNAL"))
        told = told.join(rows.select(*GROUP, *ORDER, "direction"), [*GROUP, *ORDER])
    one = F.lit(1.0)
    free = told.select(
        *GROUP, *ORDER, "direction", "verdict", one.alias("vol_mult"), one.alias("score_mult"), F.lit(1).alias("gate_version")
    )
    folded = arbiter.arbitrate(rows.join(tied, group, "left_semi"), p, carry=carry, adapt=adapt)
    if not verdicts:
        folded = folded.filter(F.col("verdict").isin("SIGNAL", "SUPPRESSED"))
    return free.select(*folded.columns).union(folded)
