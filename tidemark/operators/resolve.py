"""What became of a candidate: verdict on the later tape, and its outcome label.

Neither depends on other signals, so both are computed for every gate-passing
candidate in parallel; arbitration later only picks among finished rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.expr import clamp, floor_us, ratio
from ..functions.scan import asof_rows
from ..profile import Profile
from .gates import opening_phase

KEY = ("symbol", "session")
CAND = ("symbol", "session", "ts_us", "seq", "pref")
OBS = ("o_ts", "o_prio", "o_seq", "o_price", "imb5", "share5", "vol5", "slope", "o_mkt",
       "o_fear", "o_vol")


def observations(prints: DataFrame, bars: DataFrame, p: Profile) -> DataFrame:
    """Moments at which a live signal is looked at: price-forming prints and unit ticks.

    A tick stands at the end of its bar and comes before a print of the same instant."""
    c = F.col
    from_prints = prints.filter("updates_last").select(
        *KEY,
        c("ts_us").alias("o_ts"),
        F.lit(1).alias("o_prio"),
        c("seq").alias("o_seq"),
        c("price").alias("o_price"),
        "imb5",
        c("buy_share5").alias("share5"),
        c("v5").alias("vol5"),
        (c("ema_change") / c("price") * 1e4).alias("slope"),
        c("mkt_5m").alias("o_mkt"),
        c("fear_5m").alias("o_fear"),
        F.coalesce(ratio(c("v60"), c("base_vol")), F.lit(0.0)).alias("o_vol"),
    )
    buy, sell = c("p_buy_vol5") + c("buy_vol"), c("p_sell_vol5") + c("sell_vol")
    from_ticks = bars.select(
        *KEY,
        (c("b_us") + p.unit_us).alias("o_ts"),
        F.lit(0).alias("o_prio"),
        F.lit(0).cast("bigint").alias("o_seq"),
        c("close").alias("o_price"),
        ratio(buy - sell, buy + sell, 0.0).alias("imb5"),
        ratio(buy, buy + sell, 0.5).alias("share5"),
        (c("p_vol5") + c("vol")).alias("vol5"),
        (c("ema_change") / c("close") * 1e4).alias("slope"),
        c("mkt_5m").alias("o_mkt"),
        c("fear_5m").alias("o_fear"),
        F.coalesce(ratio(c("p_vol60") + c("vol"), c("base_vol")), F.lit(0.0)).alias("o_vol"),
    )
    return from_prints.unionByName(from_ticks)


def future_tape(cands: DataFrame, obs: DataFrame, horizon_us: int, p: Profile) -> DataFrame:
    """Observations in (alert, alert + horizon] of each candidate.

    A candidate is spread over the few macro buckets its horizon touches, so the join is
    on equality and a candidate meets only its own horizon."""
    lo = floor_us(F.col("ts_us"), p.macro_us)
    hi = floor_us(F.col("ts_us") + horizon_us, p.macro_us)
    left = cands.withColumn("_chunk", F.explode(F.sequence(lo, hi, F.lit(p.macro_us))))
    right = obs.withColumn("_chunk", floor_us(F.col("o_ts"), p.macro_us))
    joined = left.join(right, [*KEY, "_chunk"]).drop("_chunk")
    after = (F.col("o_ts") > F.col("ts_us")) | (
        (F.col("o_ts") == F.col("ts_us")) & (F.col("o_prio") == 1) & (F.col("o_seq") > F.col("seq"))
    )
    return joined.filter(after & (F.col("o_ts") <= F.col("ts_us") + horizon_us))


#: What a rule decides, in the order in which rules are asked.
VERDICTS = (
    ("FAILED", "hit invalidation"),
    ("FAILED", "directional volume reversed"),
    ("CONFIRMED", "volume sustained"),
    ("FAILED", "minute trend against"),
    ("CONFIRMED", "held at deadline"),
    ("FAILED", "minute trend against"),
    ("CONFIRMED", "progress with tailwind"),
    ("FAILED", "environment against"),
    ("FAILED", "no expansion progress"),
)


def _verdict(p: Profile, x: dict[str, np.ndarray]) -> np.ndarray:
    """Number of the first rule (from 1) that fires at each observation, 0 while undecided.  A
    missing value is NaN, which is neither above nor below anything."""
    d, level, o_price = x["direction"], x["level_price"], x["o_price"]
    share = np.where(d > 0, x["share5"], 1.0 - x["share5"])
    invalid = (o_price - x["invalidation"]) * d < 0
    past = (o_price - level) * d
    recross = past < -p.fail_buffer_bps / 1e4 * level
    dead = (x["imb5"] * d <= 0) | (share < 0.40)
    beyond = past > 0
    risk = np.abs(level - x["invalidation"])
    progress = np.zeros(len(d))
    np.divide((x["extreme"] - level) * d, risk, out=progress, where=risk > 0)
    mkt, fear = x["o_mkt"] * d, -x["o_fear"] * d
    support = (mkt > 0.02) | (fear > 0.03)
    against = (mkt < -0.03) | (fear < -0.05)
    slope_ok = np.isnan(x["slope"]) | (x["slope"] * d >= p.confirm_slope_min_bps)
    flow_ok = (share >= 0.5) | (x["imb5"] * d > 0)
    waited = x["o_ts"] - x["ts_us"]
    full = beyond & (progress >= p.confirm_min_r)
    early = (waited >= p.us(p.confirm_min_s)) & full & flow_ok & (x["vol5"] > 0)
    last = waited >= p.us(p.observe_max_s)
    near = beyond & (progress >= 0.7 * p.confirm_min_r) & support & slope_ok
    short = beyond & (progress >= 0.9 * p.confirm_min_r) & against
    rules = (
        invalid, ~x["in_open"] & recross & dead, early & slope_ok, early, last & full & slope_ok, last & full,
        last & near, last & short, last,
    )
    return np.select(rules, range(1, len(rules) + 1), 0)


def env_clause(mkt: Column, fear: Column, event_vol: Column) -> Column:
    """Short text about the market at the verdict."""
    return F.concat_ws(
        ", ",
        F.when(mkt > 0.02, "market with").when(mkt < -0.03, "market against"),
        F.when(fear > 0.03, "fear rising").when(fear < -0.03, "fear easing"),
        F.when(event_vol >= 5.0, "event tape"),
    )


#: Units of the short flow windows; after so many silent units they are empty.
SHORT = 5


def _as_is(df: DataFrame, name: str) -> DataFrame:
    return df


def timers(
    cands: DataFrame, obs: DataFrame, bars: DataFrame, p: Profile, stage: Callable[[DataFrame, str], DataFrame] = _as_is
) -> tuple[DataFrame, DataFrame]:
    """(flat bars, ticks) where the tape is silent but a candidate still waits for its verdict.

    Wide holes and the time after a symbol's last print have no bars.  Candidates bring their own
    instants there: the tick of their deadline, and the ``SHORT`` ticks after the last bar in
    which the flow windows run empty.  Each meets the last known bar as of its instant; ticks of
    a symbol are on the unit grid, so there are never more than units in its session."""
    c = F.col
    u = p.unit_us
    due = c("ts_us") + p.us(p.observe_max_s)
    due = due + F.pmod(-due, F.lit(u))
    flow = F.collect_list(F.struct("buy_vol", "sell_vol", "vol"))
    w = W.partitionBy(*KEY).orderBy("b_us")
    known = bars.select(
        *KEY, "b_us", "close", "close_us", flow.over(w.rowsBetween(1 - SHORT, 0)).alias("_flow"),
        F.lead("b_us").over(w).alias("_next"),
    )
    silent = known.filter(c("_next").isNull() | (c("_next") > c("b_us") + u))
    first = silent.select(
        *KEY, "close_us", "_next", F.explode(F.sequence(c("b_us") + u, c("b_us") + SHORT * u, F.lit(u))).alias("t_b_us")
    ).filter(c("_next").isNull() | (c("t_b_us") < c("_next")))
    ends = cands.select(*KEY, "close_us", (due - u).alias("t_b_us"))
    at = ends.unionByName(first.drop("_next")).filter(c("t_b_us") + u <= c("close_us")).select(*KEY, "t_b_us").distinct()
    at = at.join(bars.select(*KEY, c("b_us").alias("t_b_us")), [*KEY, "t_b_us"], "left_anti")
    ticks = obs.filter("o_prio = 0").select(*KEY, (c("o_ts") - u).alias("l_b_us"), "slope", "o_mkt", "o_fear", "o_vol")
    last = known.withColumn("l_b_us", c("b_us")).select(*KEY, "b_us", "l_b_us", "close", "_flow")
    found = asof_rows(at, last, KEY, "t_b_us", "b_us", ("l_b_us", "close", "_flow")).filter("l_b_us is not null")
    found = found.join(ticks, [*KEY, "l_b_us"], "left")
    gone = F.expr(f"cast((t_b_us - l_b_us) div {u} as int)")
    # of the window's SHORT units, ``gone`` are silent: the newest SHORT - gone bars are left in it
    left = F.when(gone < SHORT, F.slice("_flow", F.greatest(F.size("_flow") - (SHORT - 1 - gone), F.lit(1)), F.lit(SHORT)))
    left = F.coalesce(left, F.array().cast("array<struct<buy_vol:bigint,sell_vol:bigint,vol:bigint>>"))

    def total(name: str) -> Column:
        return F.aggregate(left, F.lit(0).cast("bigint"), lambda a, x: a + x[name])

    sums = {f"t_{k}": total(k) for k in ("buy_vol", "sell_vol", "vol")}
    found = stage(found.select(*KEY, "t_b_us", "close", "slope", "o_mkt", "o_fear", "o_vol", *[v.alias(k) for k, v in sums.items()]), "timers")
    buy, sell = c("t_buy_vol"), c("t_sell_vol")
    flat = found.select(*KEY, c("t_b_us").alias("b_us"), c("close").alias("high"), c("close").alias("low"))
    seen = found.select(
        *KEY,
        (c("t_b_us") + u).alias("o_ts"),
        F.lit(0).alias("o_prio"),
        F.lit(0).cast("bigint").alias("o_seq"),
        c("close").alias("o_price"),
        ratio(buy - sell, buy + sell, 0.0).alias("imb5"),
        ratio(buy, buy + sell, 0.5).alias("share5"),
        c("t_vol").alias("vol5"),
        "slope", "o_mkt", "o_fear", "o_vol",
    )
    return flat, seen


def _by_chunk(cands: DataFrame, p: Profile) -> DataFrame:
    """Candidates in each macro chunk of their buckets ``_lo`` to ``_hi``, to meet bars on equality.

    Spark judges a table by the size of its files, where candidates are well packed and not yet
    multiplied by their chunks: they are never broadcast, whatever that size."""
    m = p.macro_us
    chunks = F.explode(F.sequence(floor_us(F.col("_lo"), m), floor_us(F.col("_hi"), m), F.lit(m)))
    return cands.withColumn("_chunk", chunks).hint("merge")


def watched_buckets(cands: DataFrame, bars: DataFrame, p: Profile) -> DataFrame:
    """(candidate, bucket) pairs after the alert's own bucket in which a verdict is possible, with
    the extreme so far.

    A candidate meets the few dozen bars of its horizon, not their prints.  A bucket is kept only
    if its price range allows a verdict rule to fire in it; everything after a bar that surely
    invalidates is dropped."""
    c = F.col
    u = p.unit_us
    # the alert's own bar reaches back before the alert: its prints decide instead
    lo, hi = floor_us(c("ts_us"), u) + u, floor_us(c("ts_us") + p.us(p.observe_max_s) + u, u)
    left = _by_chunk(cands.withColumns({"_lo": lo, "_hi": hi}), p)
    right = bars.select(*KEY, "b_us", "high", "low", floor_us(c("b_us"), p.macro_us).alias("_chunk"))
    rows = left.join(right, [*KEY, "_chunk"]).filter(c("b_us").between(c("_lo"), c("_hi")))

    up = c("direction") > 0
    worst, best = F.when(up, c("low")).otherwise(c("high")), F.when(up, c("high")).otherwise(c("low"))
    d = c("direction")
    invalid = (worst - c("invalidation")) * d < 0
    recross = (worst - c("level_price")) * d < -p.fail_buffer_bps / 1e4 * c("level_price")
    waited = c("b_us") + u - c("ts_us")
    confirm = (waited >= p.us(p.confirm_min_s)) & ((best - c("level_price")) * d > 0)
    last = waited >= p.us(p.observe_max_s)
    w = W.partitionBy(*CAND).orderBy("b_us").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns(
        {
            "_so_far": F.max(best * d).over(w),
            "_over": F.max(invalid).over(w),
            "_maybe": invalid | recross | confirm | last,
        }
    )
    keep = rows.filter(c("_maybe") & ~F.coalesce(c("_over"), F.lit(False)))
    return keep.drop("_chunk", "_lo", "_hi", "high", "low", "_over", "_maybe")


#: Macro bars whose observations a task holds together.
TOGETHER = 8
#: Pairs of candidate and observation that are judged at a time, about.
PAIRS = 1 << 17
PAIR = ("symbol", "session", "ts_us", "seq", "pref", "direction", "price", "level_price", "invalidation", "in_open", "best")
MET = (
    "symbol string, session bigint, ts_us bigint, seq bigint, pref bigint, direction int, price double, level_price double, "
    "invalidation double, in_open boolean, best double, rule int, o_ts bigint, o_price double, extreme double, o_mkt double, "
    "o_fear double, o_vol double"
)


def _meet(p: Profile):
    """Candidates with a bucket each against the observations of these buckets, one chunk at a time."""

    def run(pairs: pa.Table, seen: pa.Table) -> pa.Table:
        n = pairs.num_rows
        seen = (seen if n else seen.slice(0, 0)).sort_by([("b_us", "ascending"), ("o_ts", "ascending"), ("o_seq", "ascending")])
        obs = {c: seen.column(c).to_numpy() for c in ("b_us", *OBS)}
        cand = {c: pairs.column(c).to_numpy() for c in ("b_us", "ts_us", "seq", "direction", "price", "level_price", "invalidation", "best")}
        cand["in_open"] = np.asarray(pairs.column("in_open").fill_null(True).to_numpy(), bool)
        lo, hi = (np.searchsorted(obs["b_us"], cand["b_us"], side) for side in ("left", "right"))
        for i in np.flatnonzero(cand["ts_us"] >= cand["b_us"]):  # of the alert's own bucket what comes after it
            a = lo[i] + np.searchsorted(obs["o_ts"][lo[i] : hi[i]], cand["ts_us"][i], "left")
            b = lo[i] + np.searchsorted(obs["o_ts"][lo[i] : hi[i]], cand["ts_us"][i], "right")
            lo[i] = a + np.searchsorted(obs["o_seq"][a:b], cand["seq"][i], "right")
        size = hi - lo
        ends = np.cumsum(size)
        rule, at = np.zeros(n, np.int32), np.full(n, -1)
        best, extreme = cand["price"] * cand["direction"], np.full(n, np.nan)
        best = np.fmax(best, cand["best"])
        top = best.copy()  # the best price of the side up to the bucket's end
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(ends, ends[i] - size[i] + PAIRS, "right")))
            own = np.repeat(np.arange(i, j), size[i:j])
            first = ends[i:j] - size[i:j]
            place = np.arange(len(own)) - np.repeat(first - first[0] - lo[i:j], size[i:j])
            x = {c: v[own] for c, v in cand.items() if c not in ("b_us", "seq", "price", "best")}
            x |= {c: obs[c][place] for c in ("o_ts", "o_price", "imb5", "share5", "vol5", "slope", "o_mkt", "o_fear")}
            reach = x["o_price"] * x["direction"]
            for k, a in enumerate(first - first[0], i):
                part = reach[a : a + size[k]]
                if len(part):
                    np.fmax.accumulate(part, out=part)
                    top[k] = np.fmax(best[k], part[-1])
            reach = np.fmax(reach, best[own])
            x["extreme"] = reach * x["direction"]
            found = _verdict(p, x)
            hit = np.flatnonzero(found)
            k, start = np.unique(own[hit], return_index=True)
            rule[k], at[k], extreme[k] = found[hit[start]], place[hit[start]], x["extreme"][hit[start]]
            i = j
        none = rule == 0
        taken = seen.take(pa.array(np.where(none, 0, at), mask=none)) if len(seen) else None
        columns = {c: pairs.column(c) for c in PAIR} | {"best": pa.array(top)}
        columns["rule"], columns["extreme"] = pa.array(rule), pa.array(extreme, mask=none)
        for c in ("o_ts", "o_price", "o_mkt", "o_fear", "o_vol"):
            kind = pa.int64() if c == "o_ts" else pa.float64()
            columns[c] = taken.column(c).cast(kind) if taken is not None else pa.nulls(n, kind)
        return pa.table({c.split()[0]: columns[c.split()[0]] for c in MET.split(", ")})

    return run


def meet(pairs: DataFrame, obs: DataFrame, p: Profile) -> DataFrame:
    """Each (candidate, bucket ``b_us``) with the first rule that fires in the bucket after the
    alert (``rule``, 0 for none) and where.  ``best`` is the candidate's extreme so far times its
    direction (null: none but its own price), and comes back as it stands after the bucket.

    Pairs never become rows of candidates times prints; a task holds the observations of a few
    macro bars of one symbol, and the candidates that watch them."""
    u, width = p.unit_us, TOGETHER * p.macro_us
    # the tick at a bar's end belongs to that bar
    at = F.col("o_ts") - F.when(F.col("o_prio") == 0, u).otherwise(0)
    chunk = floor_us(F.col("b_us"), width).alias("_chunk")
    # aliased, as both sides may come from the same prints
    right = obs.select(
        *[F.col(k).alias(k) for k in KEY], *[F.col(c).cast("double").alias(c) if c == "vol5" else c for c in OBS], floor_us(at, u).alias("b_us")
    )
    right = right.select("*", chunk).groupBy(*KEY, "_chunk")
    left = pairs.select(*PAIR, "b_us", chunk).groupBy(*KEY, "_chunk")
    return left.cogroup(right).applyInArrow(_meet(p), MET)


def resolve(
    cands: DataFrame, obs: DataFrame, bars: DataFrame, p: Profile, stage: Callable[[DataFrame, str], DataFrame] = _as_is
) -> DataFrame:
    """First verdict of each candidate; those whose session ends before their deadline may have none.

    The prints after the alert in its own bucket come first.  For candidates that they leave
    undecided, bars narrow down where a verdict can fall; only those buckets are looked at print by
    print.  Output: candidate key + resolution, reason, resolution_us, resolution_price,
    micro_extreme, env.  ``stage`` may write what is read twice."""
    c = F.col
    d = c("direction")
    none = F.lit(None).cast("double").alias("best")
    narrow = cands.select(
        *CAND, "direction", "price", "level_price", "invalidation", opening_phase(p).alias("in_open"), none,
        floor_us(c("ts_us"), p.unit_us).alias("b_us"),
    )
    flat, ticks = timers(cands, obs, bars, p, stage)
    bars = bars.select(*flat.columns).unionByName(flat)
    obs = obs.unionByName(ticks)
    own = stage(meet(narrow, obs, p), "own_bucket")
    later = watched_buckets(own.filter("rule = 0").select(*PAIR), bars, p)
    later = later.withColumn("best", F.greatest("best", "_so_far"))
    decided = own.unionByName(meet(later, obs, p)).filter("rule > 0")
    fields = F.struct(
        "rule",
        c("o_ts").alias("resolution_us"),
        c("o_price").alias("resolution_price"),
        c("extreme").alias("micro_extreme"),
        env_clause(c("o_mkt") * d, c("o_fear"), c("o_vol")).alias("env"),
    )
    out = decided.groupBy(*CAND).agg(F.min_by(fields, "o_ts").alias("_r"))
    said = [F.element_at(F.array(*map(F.lit, x)), c("_r.rule")) for x in zip(*VERDICTS, strict=True)]
    return out.select(
        *CAND, said[0].alias("resolution"), said[1].alias("reason"), "_r.resolution_us", "_r.resolution_price",
        "_r.micro_extreme", "_r.env",
    )


def label_outcomes(cands: DataFrame, bars: DataFrame, p: Profile) -> DataFrame:
    """Outcome label of each candidate over its window of micro bars.

    The window is [bar of the alert, bar of alert + outcome window]; each candidate meets
    a fixed number of bars.  Candidates whose session ends first get ``ready`` false."""
    c = F.col
    u, h = p.unit_us, p.us(p.outcome_window_s)
    d = c("direction")
    narrow = cands.select(*CAND, "direction", "price", "level_price", "invalidation")
    lo, hi = floor_us(c("ts_us"), u), floor_us(c("ts_us") + h, u)
    ends = bars.groupBy(*KEY).agg(F.max("b_us").alias("last_b_us"))
    left = _by_chunk(narrow.withColumns({"_lo": lo, "_hi": hi}), p)
    right = bars.select(*KEY, "b_us", "high", "low").withColumn(
        "_chunk", floor_us(c("b_us"), p.macro_us)
    )
    rows = left.join(right, [*KEY, "_chunk"]).filter(c("b_us").between(c("_lo"), c("_hi")))
    up = d > 0
    rows = rows.withColumns(
        {
            "fav": (F.when(up, c("high")).otherwise(c("low")) - c("price")) * d,
            "adv": (c("price") - F.when(up, c("low")).otherwise(c("high"))) * d,
            "hit": (F.when(up, c("low")).otherwise(c("high")) - c("invalidation")) * d < 0,
            "risk": F.abs(c("level_price") - c("invalidation")),
        }
    )
    dead = F.min(F.when(c("hit"), c("b_us"))).over(W.partitionBy(*CAND))
    rows = rows.withColumn("dead_us", dead)
    alive = c("dead_us").isNull() | (c("b_us") <= c("dead_us"))
    zero = F.lit(0.0)
    agg = rows.groupBy(*CAND, "direction", "price", "level_price", "invalidation", "risk").agg(
        F.greatest(F.max("fav"), zero).alias("mfe"),
        F.greatest(F.max("adv"), zero).alias("mae"),
        F.greatest(F.max(F.when(alive, c("fav"))), zero).alias("_pre"),
        F.min(F.when(c("fav") >= c("risk"), c("b_us"))).alias("_lead_b"),
    )
    total = (c("price") - c("level_price")) * d + c("mfe")
    left_frac = F.when(total > 1e-9, c("mfe") / total).otherwise(zero)
    expanded = c("_pre") >= p.pos_multiple * c("risk")
    started = c("_lead_b").isNotNull()
    ample = left_frac >= p.min_remaining_frac
    out = agg.filter(c("risk") > 0).withColumns(
        {
            "label": expanded & started & ample,
            "was_late": expanded & started & ~ample,
            "label_reason": F.when(expanded & started & ample, "expanded")
            .when(~started, "no_expansion")
            .when(~expanded, "insufficient_expansion")
            .otherwise("alert_too_late"),
            "lead_time": (c("_lead_b") + u - c("ts_us")) / u,
            "remaining_frac": clamp(left_frac, 0.0, 1.0),
            "due_us": c("ts_us") + h,
        }
    )
    return (
        out.join(ends, list(KEY), "left")
        .withColumn("ready", c("last_b_us") >= c("due_us") - u)
        .select(*CAND, "label", "label_reason", "mfe", "mae", "lead_time", "remaining_frac",
                "was_late", "due_us", "ready")
    )
