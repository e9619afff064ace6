"""Candidates and the snapshot of features behind every one of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.expr import clamp, ratio
from ..functions.scan import halo
from ..profile import Profile
from .baseline import macro_idx
from .bars import velocity
from .levels import MAJOR_KINDS, nearest, trigger_verb
from .sweeps import active_reclaims

KEY = ("symbol", "session")
RATIO_CAP = 20.0


def _range_max(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Maximum of values[a:b] for places a < b, from maxima over spans of powers of two."""
    out = np.zeros(len(a), values.dtype)
    level = np.frexp((b - a).astype(float))[1] - 1
    spans, width = values, 1
    for k in range(level.max(initial=-1) + 1):
        at = level == k
        out[at] = np.maximum(spans[a[at]], spans[b[at] - width])
        spans, width = np.maximum(spans[:-width], spans[width:]), 2 * width
    return out


def _starts(rows: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    """Which rows begin a new run of equal keys."""
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for k in keys:
        x, y = rows.column(k)[:-1], rows.column(k)[1:]
        other = pc.or_(pc.fill_null(pc.not_equal(x, y), False), pc.xor(pc.is_null(x), pc.is_null(y)))
        new[1:] |= other.to_numpy()
    return new


def _one_sided(back: int, near: int, chunk: int, unit_us: int):
    """Adds the persistence columns to rows sorted by key, chunk and time, whole chunks at once.

    Chunks are laid out apart on one axis; window edges are found by binary search, and values
    are differences of running totals, so work does not grow with the prints inside a window."""
    keys = (*KEY, "_c")
    apart = 2 * (chunk + max(back, near))

    def judged(rows: pa.Table) -> pa.Table:
        ts, size = (rows.column(c).to_numpy() for c in ("ts_us", "_size"))
        flow, sign, here = (rows.column(c).to_numpy() for c in ("_flow", "_sign", "_own"))
        axis = np.cumsum(_starts(rows, keys)) * apart + (ts - rows.column("_c").to_numpy())
        at = axis[here]

        def window(own: np.ndarray, span: int):
            mine = axis[own]
            return mine, np.searchsorted(mine, at - span, "left"), np.searchsorted(mine, at, "right")

        _, a, b = window(flow, near)
        cols = {"n2s": b - a}
        for name, way in (("up", 1), ("dn", -1)):
            own = flow & (sign == way)
            mine, a, b = window(own, back)
            count, span, dom = b - a, np.zeros(len(at)), np.ones(len(at))
            many, some = count >= 2, count >= 1
            span[many] = (mine[b[many] - 1] - mine[a[many]]) / unit_us
            sums = np.concatenate((np.zeros(1, size.dtype), np.cumsum(size[own])))
            total, top = sums[b] - sums[a], np.zeros(len(at), size.dtype)
            top[some] = _range_max(size[own], a[some], b[some])
            np.divide(top, total, out=dom, where=total > 0)
            cols |= {f"persist_{name}": count, f"span_{name}": span, f"dom_{name}": dom}
        out = rows.filter(rows.column("_own")).drop_columns([c for c in rows.column_names if c in HELP])
        for name, values in cols.items():
            out = out.append_column(name, pa.array(values))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def place(batch: pa.RecordBatch, i: int):
            return [batch.column(k)[i].as_py() for k in keys]

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if place(held[0], 0) == place(batch, batch.num_rows - 1):
                continue
            rows = pa.Table.from_batches(held)
            last = int(np.flatnonzero(_starts(rows, keys))[-1])
            yield from judged(rows.slice(0, last)).to_batches()
            held = rows.slice(last).to_batches()
        if held:
            yield from judged(pa.Table.from_batches(held)).to_batches()

    return run


HELP = ("_own", "_c", "_flow", "_sign", "_size")
PERSISTENCE = ("n2s long, persist_up long, span_up double, dom_up double, "
               "persist_dn long, span_dn double, dom_dn double")  # fmt: skip


def with_persistence(prints: DataFrame, p: Profile) -> DataFrame:
    """How one-sided the last moments were, for both directions, at every print.

    A window over event time; chunks carry a short halo, so a hot symbol is spread
    over as many tasks as it has chunks.  Prints of one microsecond count together."""
    back, near = p.us(p.persist_window_s), p.us(p.persist_short_s)
    chunk = max(p.macro_us, back, near)
    flow = F.coalesce("flow_eligible", F.lit(False))
    # a print without a size counts, but adds nothing
    rows = halo(prints, "ts_us", chunk, max(back, near), "_c").withColumns(
        {
            "_flow": flow,
            "_sign": F.coalesce("side", F.lit(0)).cast("int"),
            "_size": F.coalesce("size", F.lit(0)).cast("long"),
        }
    )
    schema = StructType(prints.schema.fields + StructType.fromDDL(PERSISTENCE).fields)
    ordered = rows.repartition(*KEY, "_c").sortWithinPartitions(*KEY, "_c", "ts_us")
    return ordered.mapInArrow(_one_sided(back, near, chunk, p.unit_us), schema)


def may_evaluate() -> Column:
    """Prints that may start a candidate: price-forming flow inside the session."""
    return F.col("updates_last") & F.col("flow_eligible") & (F.col("ts_us") >= F.col("open_us"))


def oriented(prints: DataFrame, p: Profile) -> DataFrame:
    """Prints that may start a candidate, once per direction, with all that a direction alone decides.

    A print meets every fresh reclaim, so what does not look at the level is worked out here,
    ahead of the levels, and only carried along.  ``near`` is the nearest escaped level."""
    c = F.col
    d = c("direction")
    dv5, dv15 = c("vel5") * d, c("vel15") * d
    accel = (dv5 > 0) & ((dv15 <= 0) | (dv5 >= p.accel_ratio * dv15))

    def side(name: str) -> Column:
        return F.when(d > 0, c(f"{name}_up")).otherwise(c(f"{name}_dn"))

    frac = (p.ready_bps + p.break_max_bps) / 1e4
    near = F.when(d > 0, nearest(c("levels"), c("price"), frac, 1)).otherwise(
        nearest(c("levels"), c("price"), frac, -1)
    )
    ways = prints.filter(may_evaluate()).withColumn("direction", F.explode(F.array(F.lit(1), F.lit(-1))))
    return ways.withColumns(
        {
            "near": near,
            "accelerating": accel,
            "persist_trades": side("persist"),
            "persist_span": side("span"),
            "dominant_frac": side("dom"),
            "mkt_al_1m": c("mkt_1m") * d,
            "mkt_al_5m": c("mkt_5m") * d,
            "is_trend": F.lit(0.0),
        }
    ).drop(
        "persist_up", "persist_dn", "span_up", "span_dn", "dom_up", "dom_dn", "mkt_1m", "mkt_5m", "levels"
    )


def level_candidates(ways: DataFrame) -> DataFrame:
    """Oriented prints with their nearest escaped level."""
    return ways.filter("near is not null").select(
        *[c for c in ways.columns if c != "near"],
        F.when(F.col("direction") > 0, 0).otherwise(1).cast("bigint").alias("pref"),
        F.col("near.price").alias("level_price"),
        F.col("near.kind").alias("level_kind"),
        F.lit(False).alias("is_reclaim"),
    )


def reclaim_candidates(ways: DataFrame, reclaims: DataFrame, p: Profile) -> DataFrame:
    """Oriented prints still beyond a freshly reclaimed level."""
    rows = active_reclaims(ways.drop("near"), reclaims, p)
    beyond = (F.col("price") - F.col("level_price")) * F.col("direction") > 0
    return (
        rows.filter(beyond)
        .withColumn("pref", F.col("r_idx") + 2)
        .withColumn("is_reclaim", F.lit(True))
        .drop("r_idx", "r_ts_us")
    )


def candidates(ways: DataFrame, reclaims: DataFrame, p: Profile) -> DataFrame:
    """All candidates; ``pref`` orders them inside one print (up, down, reclaims)."""
    return level_candidates(ways).unionByName(reclaim_candidates(ways, reclaims, p))


def burst_ratio(recent: Column, total: Column) -> Column:
    """Last five units against the average five units of the fifty-five before."""
    prior = (total - recent) / 11.0
    return F.when(prior > 1e-9, recent / prior).otherwise(
        F.when(recent > 0, F.lit(RATIO_CAP)).otherwise(F.lit(0.0))
    )


def with_flow_features(prints: DataFrame, p: Profile) -> DataFrame:
    """Direction-free features of a print (everything but level and direction)."""
    c = F.col
    price = c("price")
    idx = macro_idx(c("ts_us"), c("open_us"), p)
    young = c("idx") < p.baseline_skip_open_min
    base5 = c("base_vol") / p.macro_slices
    avg1m = F.coalesce(c("avg_range5"), F.lit(0.0)) / price * 1e4
    range15 = F.coalesce((c("hi15") - c("lo15")) / price * 1e4, F.lit(0.0))
    quote = c("quote")
    sizes = quote["bid_size"] + quote["ask_size"]
    plain = burst_ratio(c("v5"), c("v60"))
    out = prints.withColumn("idx", idx)
    return out.withColumns(
        {
            "vel5": velocity(price, c("ago5"), 5),
            "vel15": velocity(price, c("ago15"), 15),
            "vol_ratio_prev": F.when(young & (c("midday5") > 0), c("v5") / c("midday5")).otherwise(
                plain
            ),
            "vol_ratio_base": F.when(young | ~(base5 > 0), F.lit(0.0)).otherwise(c("v5") / base5),
            "imb5": ratio(c("b5") - c("s5"), c("b5") + c("s5"), 0.0),
            "imb15": ratio(c("b15") - c("s15"), c("b15") + c("s15"), 0.0),
            "buy_share5": ratio(c("b5"), c("b5") + c("s5"), 0.5),
            "n_ratio_prev": burst_ratio(c("n5"), c("n60")),
            "range_exp": F.when(avg1m > 0, range15 / (avg1m / 2.0)).otherwise(F.lit(1.0)),
            "dist_vwap_bps": F.coalesce((price - c("vwap")) / c("vwap") * 1e4, F.lit(0.0)),
            "spread_bps": F.coalesce(
                (quote["ask"] - quote["bid"]) / quote["bid"] * 1e4, F.lit(0.0)
            ),
            "quote_imb": ratio(quote["bid_size"] - quote["ask_size"], sizes, 0.0),
            "minute_frac": clamp(c("idx") / float(p.session_macros), 0.0, 1.0),
        }
    )


def snapshots(cands: DataFrame) -> DataFrame:
    """Complete a candidate with its level-dependent features."""
    c = F.col
    d = c("direction")
    return cands.withColumns(
        {
            "break_bps": (c("price") - c("level_price")) / c("level_price") * 1e4 * d,
            "trigger_verb": trigger_verb(c("level_kind"), d, c("is_reclaim")),
        }
    )


# Feature names in their published order.
FEATURES = (
    "dir", "break_bps", "vel5", "vel15", "accel", "vol_prev", "vol_base", "imb5", "imb15",
    "n_prev", "range_exp", "comp", "dist_vwap", "spread", "q_imb", "minute", "persist",
    "dominance", "mkt_al_1m", "mkt_al_5m", "fear_1m", "fear_5m", "level_major", "is_reclaim",
    "trend",
)


def feature_columns() -> dict[str, Column]:
    """The 25 model-facing features of a snapshot, clipped and direction-aligned."""
    c = F.col
    d = c("direction")

    def cap(name: str, top: float) -> Column:
        return F.least(c(name), F.lit(top))

    cols = (
        d.cast("double"),
        c("break_bps"),
        c("vel5") * d,
        c("vel15") * d,
        c("accelerating").cast("double"),
        cap("vol_ratio_prev", 20.0),
        cap("vol_ratio_base", 20.0),
        c("imb5") * d,
        c("imb15") * d,
        cap("n_ratio_prev", 20.0),
        cap("range_exp", 10.0),
        cap("comp_ratio", 3.0),
        clamp(c("dist_vwap_bps") * d, -100.0, 100.0),
        cap("spread_bps", 50.0),
        c("quote_imb") * d,
        c("minute_frac"),
        c("persist_trades").cast("double"),
        c("dominant_frac"),
        c("mkt_al_1m"),
        c("mkt_al_5m"),
        c("fear_1m"),
        c("fear_5m"),
        c("level_kind").isin(*MAJOR_KINDS).cast("double"),
        (c("trigger_verb") == "reclaim").cast("double"),
        c("is_trend"),
    )
    return dict(zip(FEATURES, cols, strict=True))


def with_features(snaps: DataFrame) -> DataFrame:
    packed = F.struct(*[v.alias(k) for k, v in feature_columns().items()])
    return snaps.withColumn("features", packed)
