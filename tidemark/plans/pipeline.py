"""The whole analysis as one lazy plan, stage by stage.

Each property is a DataFrame over the previous stages; nothing runs until an action.
With ``cut`` the stages that many others read are written as stage tables, once per
``Tape``; otherwise the plan of a late stage would repeat the early ones many times."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.durable import durable
from ..functions.expr import floor_us, order_key
from ..operators import bars as B
from ..operators import baseline as base
from ..operators import context as ctx
from ..operators import gates, levels, resolve, session, sides, snapshot, sweeps, trend, warmup
from ..operators.ingest import alertable, clean, late_demote, rebucket_late
from ..profile import Profile

KEY = ["symbol", "session"]


@dataclass
class Tape:
    """Inputs of a run: raw prints, quotes, the session calendar and a profile; with
    ``warm`` sessions go on from historical bars at the instant their tape starts.  With
    ``late`` the tape is taken as it arrived: late prints keep their volume only, and count in
    the bucket that was open when they came, as in the stream.  Where ``health`` (rows of
    ``health_changes``) has alerts switched off, and from prints flagged ``is_backfill``, no
    candidate starts; such prints still make bars, levels and verdicts."""

    prints: DataFrame
    quotes: DataFrame
    sessions: DataFrame
    profile: Profile
    market: str = ""
    fear: str = ""
    cut: bool = True
    warm: warmup.WarmUp | None = None
    late: bool = False
    health: DataFrame | None = None

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        return durable(df, name) if self.cut else df

    # ------------------------------------------------------------- warm-up

    @cached_property
    def past_minutes(self) -> DataFrame:
        """Historical minute bars of all sessions."""
        w = self.warm
        return self.stage(warmup.in_sessions(w.minutes, self.sessions, self.profile, w.zone), "past_minutes")

    @cached_property
    def seeds(self) -> DataFrame | None:
        """What each warmed-up (symbol, session) knows before its first print."""
        w = self.warm
        if w is None:
            return None
        early = self.past_minutes
        if w.premarket is not None:
            early = warmup.in_sessions(w.premarket, self.sessions, self.profile, w.zone)
        return self.stage(warmup.state_seeds(self.past_minutes, early, w.starts, self.profile), "seeds")

    @cached_property
    def preopen(self) -> DataFrame | None:
        """Flat units before the open of sessions that start there."""
        if self.warm is None:
            return None
        p = self.profile
        last = self.seeds.filter("preopen").select(*KEY, F.col("pm_close").alias("price"), "open_us", "close_us")
        units = min(60, p.premarket_us // p.unit_us)
        return self.stage(B.preopen_seed(self.micro, last, p, units), "preopen")

    # ------------------------------------------------------------- bars and state

    @cached_property
    def sided(self) -> DataFrame:
        """Clean prints with quote, previous flow price and side."""
        rows = clean(self.prints)
        if self.late:
            rows = late_demote(rows, self.profile).drop("watermark_us", "late")
        out = sides.classify_sides(rows, self.quotes, self.profile, self.seeds)
        return self.stage(out, "sided")

    @cached_property
    def micro(self) -> DataFrame:
        if self.late:
            return B.arrival_bars(rebucket_late(self.sided, self.profile), self.seeds)
        return B.micro_bars(self.sided, self.profile, self.seeds)

    @cached_property
    def filled(self) -> DataFrame:
        bars = self.micro if self.warm is None else self.micro.unionByName(self.preopen)
        return self.stage(B.gap_fill(bars, self.profile), "filled")

    @cached_property
    def macro(self) -> DataFrame:
        """Macro bars of the tape, and of the warmed-up session before it."""
        if self.warm is None:
            return B.macro_bars(self.filled, self.profile)
        # what stands in for the time before the open is not traded time
        own = self.filled.join(self.preopen.select(*KEY, "b_us"), [*KEY, "b_us"], "left_anti")
        live = B.macro_bars(own, self.profile)
        before = warmup.session_minutes(self.past_minutes, self.warm.starts, self.profile)
        return self.stage(live.unionByName(before.select(*live.columns)), "macro")

    @cached_property
    def baseline(self) -> DataFrame:
        bars = self.macro
        if self.warm is not None:
            older = self.past_minutes.join(bars.select(*KEY, "m_us"), [*KEY, "m_us"], "left_anti")
            bars = bars.unionByName(older.select(*bars.columns))
        return base.minute_baseline(bars, self.sessions, self.profile)

    @cached_property
    def fallback(self) -> DataFrame:
        return base.baseline_fallback(self.baseline, self.profile)

    @cached_property
    def static(self) -> DataFrame:
        daily = session.daily_bars(self.micro)
        past = None if self.warm is None else warmup.day_bars(self.warm.days)
        return levels.static_levels(
            session.prior_day_levels(daily, self.profile, past), self.premarket
        )

    @cached_property
    def premarket(self) -> DataFrame:
        if self.warm is None:
            return session.premarket_levels(self.filled, self.profile)
        own = self.filled.join(self.preopen.select(*KEY, "b_us"), [*KEY, "b_us"], "left_anti")
        live = session.premarket_levels(own, self.profile)
        past = self.seeds.filter("pm_close is not null").select(*live.columns)
        # the tape comes after the bars, so its close is the later one
        both = past.withColumn("_turn", F.lit(0)).unionByName(live.withColumn("_turn", F.lit(1)))
        return both.groupBy(*KEY).agg(
            F.max("pmh").alias("pmh"),
            F.min("pml").alias("pml"),
            F.max_by("pm_close", "_turn").alias("pm_close"),
        )

    @cached_property
    def opening(self) -> DataFrame:
        p = self.profile
        live = session.opening_range(self.sided, p)
        if self.warm is None:
            return live
        end = F.col("open_us") + p.opening_range_macros * p.macro_us
        known = self.seeds.filter("or_high is not null").select(*KEY, "or_high", "or_low", end.alias("or_eff_us"))
        return live.join(known, KEY, "left_anti").unionByName(known)

    @cached_property
    def structure(self) -> DataFrame:
        out = levels.macro_structure(self.macro, self.profile, self.seeds)
        return self.stage(out, "structure")

    @cached_property
    def bar_state(self) -> DataFrame:
        """Everything known at the start of each bucket, one row per filled bar."""
        p = self.profile
        rows = B.with_bar_windows(self.filled, seeds=self.seeds)
        rows = levels.bucket_state(rows, self.structure)
        rows = rows.withColumn("bidx", base.macro_idx(F.col("b_us"), F.col("open_us"), p))
        rows = base.with_baseline(rows, self.baseline, self.fallback, "bidx").drop("bidx")
        out = ctx.with_context(rows, self.filled, self.market, self.fear, p)

    # ------------------------------------------------------------- prints
        return self.stage(out, "bar_state")

    @cached_property
    def flow(self) -> DataFrame:
        """Prints with rolling windows, bucket state and direction-free features."""
        p = self.profile
        rows = snapshot.with_persistence(self.sided, p)
        state = self.bar_state.drop("dynamic")
        out = snapshot.with_flow_features(B.print_windows(rows, state, p), p)
        return self.stage(out, "flow")

    @cached_property
    def vwap0(self) -> DataFrame:
        """VWAP at the first price-forming print of each bucket."""
        p = self.profile
        bars = B.with_bar_windows(self.filled, (), (), (), self.seeds)
        w = B.print_windows(self.sided, bars, p, ())
        return (
            w.filter("updates_last")
            .groupBy(*KEY, "b_us")
            .agg(F.min_by("vwap", order_key(F.col("ts_us"), F.col("seq"))).alias("vwap0"))
        )

    @cached_property
    def bucket_levels(self) -> DataFrame:
        p = self.profile
        cols = [*KEY, "b_us"]
        state = levels.bucket_state(self.micro.select(*cols), self.structure)
        rows = state.select(*cols, "epoch", "dynamic").join(self.vwap0, cols)
        rows = levels.bucket_levels(
            rows.drop("vwap0"), self.static.drop("pmh", "pml"), self.opening, self.vwap0, p
        )
        out = rows.select(*cols, "epoch", "levels")
        return self.stage(out, "bucket_levels")

    @cached_property
    def epoch_levels(self) -> DataFrame:
        return levels.epoch_levels(
            self.structure, self.static.drop("pmh", "pml"), self.opening, self.profile
        )

    @cached_property
    def reclaims(self) -> DataFrame:
        p = self.profile
        forming = self.sided.filter("updates_last").select(*KEY, "ts_us", "seq", "price")
        forming = forming.withColumn("b_us", floor_us(F.col("ts_us"), p.unit_us))
        obs = sweeps.level_observations(forming, self.bucket_levels, self.epoch_levels, p)
        obs = self.stage(obs, "level_observations")
        return self.stage(sweeps.sweep_reclaims(obs, p), "reclaims")

    @cached_property
    def leveled(self) -> DataFrame:
        """Flow rows with their bucket's merged levels."""
        lv = self.bucket_levels.select(*KEY, "b_us", "levels")
        return self.flow.join(lv, [*KEY, "b_us"], "left")

    # ------------------------------------------------------------- candidates

    @cached_property
    def ways(self) -> DataFrame:
        """Prints that may start a candidate, once per direction, judged as far as without a level."""
        rows = self.leveled
        if "is_backfill" in rows.columns:
            rows = rows.filter(~F.coalesce("is_backfill", F.lit(False)))
        if self.health is not None:
            rows = alertable(rows, self.health, self.profile)
        out = gates.by_way(snapshot.oriented(rows, self.profile), self.profile)
        return self.stage(out, "ways")

    def judged(self, ways: DataFrame) -> DataFrame:
        """Candidates of ``ways`` (some of its rows, or with further columns) with score and gates."""
        cands = snapshot.candidates(ways, self.reclaims, self.profile)
        return gates.evaluate(snapshot.snapshots(cands), self.profile)

    @cached_property
    def evaluated(self) -> DataFrame:
        """Every candidate with score and gates.  Prints times fresh reclaims are by far the most
        rows of a run, and a reader wants few of them or few columns: never written."""
        return self.judged(self.ways)

    @cached_property
    def promising(self) -> DataFrame:
        """Candidates that pass, or would (``loose``) under the loosest adaptive multipliers.
        Prints that fail on their own, whatever the level, meet no reclaims."""
        p = self.profile
        loose = gates.gate_reason(p, F.col("loose_reason"), p.bound_low).isNull()
        some = self.ways.filter("way_reason is null or loose_reason is null")
        out = self.judged(some).withColumn("loose", loose).filter("loose or gate_reason is null")
        return self.stage(out, "promising")

    @cached_property
    def passing(self) -> DataFrame:
        return self.promising.filter("gate_reason is null").drop("loose")

    @cached_property
    def trends(self) -> DataFrame:
        out = trend.trend_onset(self.bar_state, self.static, self.profile)
        return out if self.health is None else alertable(out, self.health, self.profile, "ts_us")

    @cached_property
    def observations(self) -> DataFrame:
        return resolve.observations(self.flow, self.bar_state, self.profile)

    @cached_property
    def resolutions(self) -> DataFrame:
        return resolve.resolve(self.passing, self.observations, self.filled, self.profile, self.stage)

    @cached_property
    def labels(self) -> DataFrame:
        return resolve.label_outcomes(self.passing, self.filled, self.profile)
