"""The adaptive gate over many labels, without a task a run.

What the gate does at a label follows from the labels alone:

1. Labels are numbered by a chunked scan; hits among the newest ones are a short window over
   chunks with a halo.  That marks the *low* labels, at which an awake gate would revert.
2. After a revert the gate sleeps for a fixed number of labels.  Where a chunk of labels is
   entered with the gate waking at offset e, a table tells with which offset it is left; one table
   a chunk (``_leaps``) is all that is scanned over a run.  Chunks then list their own reverts.
3. Reverts cut a run into versions.  Inside a version each multiplier is a product clamped after
   every label, and clamped steps compose (``scan.clamped``), so a key with all labels is split.

``snapshot`` keeps the state after the last label as one row a run, and a timeline that is given
such rows goes on as if it had never stopped."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scan import ROW_CHUNK, Running, clamped, halo, running
from ..profile import Profile

KEY = ("symbol", "bucket")
TIMELINE = ("run_id", "seq", *KEY, "mult", "n_labels", "reverted", "active", "version")
SNAPSHOT = (
    "run_id string, seq bigint, n_labels bigint, baseline double, version int, wakes_at bigint, "
    "recent array<boolean>, mults array<struct<symbol: string, bucket: int, mult: double>>"
)
Stage = Callable[[DataFrame, str], DataFrame]


def sleep(p: Profile) -> int:
    """Labels from a revert until multipliers count again."""
    return max(10, p.min_labels // 2)


def window(p: Profile) -> int:
    return max(8, p.revert_window)


def step(p: Profile) -> Column:
    """What one outcome does to its multiplier."""
    late = F.when(F.col("was_late"), 2.0).otherwise(1.0)
    return F.when(F.col("label"), 1.0 - p.adapt_step).otherwise(1.0 + p.adapt_step * late)


def _numbered(outcomes: DataFrame, state: DataFrame | None) -> DataFrame:
    """Outcomes with their number in the run; with a snapshot, behind its remembered labels,
    which are marked ``_old`` and have no ``seq``."""
    rows = outcomes.select("run_id", "seq", *KEY, "label", "was_late", F.expr(f"seq div {ROW_CHUNK}").alias("_chunk"))
    count = Running("_n", "sum", F.lit(1).cast("bigint"))
    start = state.select("run_id", F.col("n_labels").alias("_n")) if state is not None else None
    rows = running(rows, ["run_id"], "_chunk", ["seq"], [count], initial=start).drop("_chunk").withColumn("_old", F.lit(False))
    if state is None:
        return rows
    old = state.select("run_id", "n_labels", F.size("recent").alias("_k"), F.posexplode("recent").alias("_i", "label"))
    old = old.select("run_id", "label", (F.col("n_labels") - F.col("_k") + F.col("_i") + 1).alias("_n"), F.lit(True).alias("_old"))
    return rows.unionByName(old, allowMissingColumns=True)


def _baselines(rows: DataFrame, p: Profile, state: DataFrame | None) -> DataFrame:
    """Share of hits among a run's first labels, once there are enough of them."""
    first = rows.filter(F.col("_n") <= p.min_labels).groupBy("run_id").agg(
        F.count("*").alias("_k"), F.avg(F.col("label").cast("double")).alias("baseline")
    )
    fresh = first.filter(F.col("_k") == p.min_labels).select("run_id", "baseline")
    if state is None:
        return fresh
    kept = state.filter("baseline is not null").select("run_id", "baseline")
    return kept.unionByName(fresh.join(kept, "run_id", "left_anti"))


def _lows(rows: DataFrame, baselines: DataFrame, p: Profile, width: int, state: DataFrame | None) -> DataFrame:
    """(run_id, _s, _c, _low): per chunk of numbers the offsets at which an awake gate reverts.

    Chunks begin behind the ``_s`` labels of the run's snapshot."""
    back = window(p) - 1
    near = halo(rows.select("run_id", "_n", "label", "_old"), "_n", max(ROW_CHUNK, back), back, "_h")
    w = W.partitionBy("run_id", "_h").orderBy("_n").rowsBetween(-back, 0)
    seen = near.select("run_id", "_n", "_own", "_old", F.sum(F.col("label").cast("bigint")).over(w).alias("_hits"), F.count("*").over(w).alias("_k"))
    seen = seen.filter((F.col("_n") >= p.min_labels) & F.col("_own") & ~F.col("_old")).join(baselines, "run_id")
    low = (F.col("_k") >= max(8, p.revert_window // 2)) & (
        F.col("_hits") / F.col("_k") < F.col("baseline") - p.revert_precision_drop
    )
    seen = seen.filter(low)
    if state is None:
        seen = seen.withColumn("_s", F.lit(0).cast("bigint"))
    else:
        known = state.select("run_id", F.col("n_labels").alias("_s"))
        seen = seen.join(known, "run_id", "left").withColumn("_s", F.coalesce("_s", F.lit(0).cast("bigint")))
    c = F.expr(f"(_n - _s) div {width}")
    return seen.groupBy("run_id", "_s", c.alias("_c")).agg(
        F.array_sort(F.collect_list((F.col("_n") - F.col("_s") - c * width).cast("int"))).alias("_low")  # at most ``width``
    )


def _leaps(width: int, rest: int, entries: int):
    """Per chunk, for each offset at which the gate may wake in it, that of the next chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tables = []
            for low in batch.column("_low"):
                at = np.asarray(low.values)
                leave = np.zeros(len(at) + 1, np.int64)  # none left: awake in the next chunk
                then = np.searchsorted(at, at + rest)
                for i in range(len(at) - 1, -1, -1):
                    leave[i] = leave[then[i]] if then[i] < len(at) else max(0, at[i] + rest - width)
                tables.append(leave[np.searchsorted(at, np.arange(entries))])
            lists = pa.array(tables, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("run_id"), batch.column("_c"), lists], ["run_id", "_c", "_t"])

    return run


def _entries(width: int):
    """Offset at which the gate wakes in each chunk, from the tables of the chunks before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, wakes = None, 0
        for batch in batches:
            out = []
            rows = zip(batch.column("run_id").to_pylist(), batch.column("_c").to_pylist(), batch.column("_t"), batch.column("_w").to_pylist(), strict=True)
            for run_id, c, table, first in rows:
                if run_id != here:
                    here, wakes = run_id, first
                out.append(max(0, wakes - c * width))
                wakes = (c + 1) * width + table[out[-1]].as_py()
            yield pa.RecordBatch.from_arrays([batch.column("run_id"), batch.column("_c"), pa.array(out, pa.int64())], ["run_id", "_c", "_e"])

    return run


def _own_reverts(rest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for low, wakes in zip(batch.column("_low"), batch.column("_e").to_pylist(), strict=True):
                at, own = np.asarray(low.values), []
                i = np.searchsorted(at, wakes)
                while i < len(at):
                    own.append(int(at[i]))
                    i = np.searchsorted(at, at[i] + rest)
                out.append(own)
            lists = pa.array(out, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("run_id", "_s", "_c")), lists], ["run_id", "_s", "_c", "_r"])

    return run


def reverts(rows: DataFrame, baselines: DataFrame, p: Profile, state: DataFrame | None, stage: Stage) -> DataFrame:
    """(run_id, _n): labels at which the gate reverted."""
    rest = sleep(p)
    entries = max(rest, p.min_labels) + 1
    width = max(ROW_CHUNK, entries)
    lows = stage(_lows(rows, baselines, p, width, state), "lows")
    tables = lows.drop("_s").mapInArrow(_leaps(width, rest, entries), "run_id string, _c bigint, _t array<int>")
    if state is None:
        tables = tables.withColumn("_w", F.lit(p.min_labels).cast("bigint"))
    else:
        known = state.select("run_id", (F.col("wakes_at") - F.col("n_labels")).alias("_w"))
        tables = tables.join(known, "run_id", "left").withColumn("_w", F.coalesce("_w", F.lit(p.min_labels).cast("bigint")))
    ordered = tables.repartition("run_id").sortWithinPartitions("run_id", "_c")
    entered = ordered.mapInArrow(_entries(width), "run_id string, _c bigint, _e bigint")
    own = lows.join(entered, ["run_id", "_c"]).mapInArrow(_own_reverts(rest), "run_id string, _s bigint, _c bigint, _r array<int>")
    return own.select("run_id", "_s", "_c", F.explode("_r").alias("_o")).select(
        "run_id", (F.col("_s") + F.col("_c") * width + F.col("_o")).alias("_n")
    )


def _unfolded(outcomes: DataFrame, p: Profile, state: DataFrame | None, stage: Stage) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Timeline with its helper columns, numbered rows and baselines."""
    rows = stage(_numbered(outcomes, state), "numbered")
    baselines = stage(_baselines(rows, p, state), "baselines")
    found = reverts(rows, baselines, p, state, stage).withColumn("_hit", F.lit(True))
    new = rows.filter(~F.col("_old")).drop("_old").join(found, ["run_id", "_n"], "left")
    hit = F.col("_hit").isNotNull()
    specs = [
        Running("_past", "sum", hit.cast("int")),
        Running("_at", "last", F.when(hit, F.col("_n"))),
    ]
    new = running(new.withColumn("_c", F.expr(f"_n div {ROW_CHUNK}")), ["run_id"], "_c", ["_n"], specs)
    # a label that makes the gate revert still belongs to the version it ends
    new = new.withColumn("_part", F.col("_past") - hit.cast("int"))
    start = None
    if state is not None:
        start = state.select("run_id", F.lit(0).cast("bigint").alias("_part"), F.explode("mults").alias("_m")).select("run_id", "_m.symbol", "_m.bucket", "_part", F.col("_m.mult").alias("_raw"))
        new = new.join(state.select("run_id", F.col("version").alias("_v"), F.col("wakes_at").alias("_w")), "run_id", "left")
    else:
        new = new.withColumns({"_v": F.lit(None).cast("int"), "_w": F.lit(None).cast("bigint")})
    told = clamped(new, ["run_id", *KEY, "_part"], "_c", "_n", step(p), p.bound_low, p.bound_high, "_raw", start)
    first = F.coalesce("_w", F.lit(p.min_labels).cast("bigint"))
    told = told.withColumns(
        {
            "mult": F.when(hit, 1.0).otherwise(F.col("_raw")),
            "n_labels": F.col("_n"),
            "version": (F.coalesce("_v", F.lit(1)) + F.col("_past")).cast("int"),
            "_wakes": F.coalesce(F.col("_at") + sleep(p), first),
        }
    )
    told = told.withColumn("active", F.col("_n") >= F.col("_wakes"))
    return told.withColumn("reverted", (F.col("version") > 1) & ~F.col("active")), rows, baselines


def _as_is(df: DataFrame, name: str) -> DataFrame:
    return df


def gate_timeline(outcomes: DataFrame, p: Profile, state: DataFrame | None = None, stage: Stage = _as_is) -> DataFrame:
    """State of the adaptive gate after every label, in label order per run.

    ``outcomes``: run_id, seq (rising, unique in a run), symbol, bucket, label, was_late.
    ``state`` are rows of ``snapshot``: their runs go on where they stood, all others start anew.
    ``stage`` may write what is read more than once.  Without outcomes there are no rows."""
    return _unfolded(outcomes, p, state, stage)[0].select(*TIMELINE)


def snapshot(outcomes: DataFrame, p: Profile, state: DataFrame | None = None, stage: Stage = _as_is) -> DataFrame:
    """What a run has to remember after its last label, one row a run (see ``SNAPSHOT``).

    Runs that have a ``state`` but no new outcomes keep it.  A row holds the newest labels of the
    revert window and a number for each (symbol, day part); both are bounded by the universe."""
    told, rows, baselines = _unfolded(outcomes, p, state, stage)
    told = stage(told, "told")
    last = told.groupBy("run_id").agg(
        *[F.max_by(c, "_n").alias(c) for c in ("seq", "version")],
        F.max("_n").alias("n_labels"), F.max_by("_wakes", "_n").alias("wakes_at"), F.max("_past").alias("_past"),
    )
    ends = told.filter(F.col("_hit").isNull()).groupBy("run_id", "_part", *KEY).agg(F.max_by("mult", "_n").alias("mult"))
    if state is not None:
        kept = state.select("run_id", F.lit(0).cast("bigint").alias("_part"), F.explode("mults").alias("_m"))
        kept = kept.select("run_id", "_part", "_m.*").join(ends, ["run_id", "_part", *KEY], "left_anti")
        ends = ends.unionByName(kept)
    ends = ends.join(last.select("run_id", F.col("_past").alias("_part")), ["run_id", "_part"], "left_semi")
    mults = ends.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct(*KEY, "mult"))).alias("mults"))
    newest = rows.join(last.select("run_id", "n_labels"), "run_id").filter(F.col("_n") > F.col("n_labels") - window(p))
    pairs = F.array_sort(F.collect_list(F.struct("_n", "label")))
    recent = newest.groupBy("run_id").agg(F.transform(pairs, lambda x: x["label"]).alias("recent"))
    out = last.join(baselines, "run_id", "left").join(recent, "run_id").join(mults, "run_id", "left")
    out = out.withColumn("mults", F.coalesce("mults", F.array().cast("array<struct<symbol: string, bucket: int, mult: double>>")))
    names = [c.split()[0] for c in ("run_id", "seq", "n_labels", "baseline", "version", "wakes_at", "recent", "mults")]
    out = out.select(*names)
    if state is not None:
        out = out.unionByName(state.join(last, "run_id", "left_anti").select(*names))
    return out


def save(states: DataFrame, path: str, session: int) -> None:
    """Keep the states that runs had after ``session``; the same session again replaces its own."""
    states.write.mode("overwrite").parquet(f"{path}/session={session}")


def load(spark: SparkSession, path: str, session: int | None = None) -> DataFrame:
    """Each run's newest state, of those up to ``session`` if one is given."""
    rows = spark.read.option("basePath", path).schema(f"{SNAPSHOT}, session bigint").parquet(path)
    if session is not None:
        rows = rows.filter(F.col("session") <= session)
    names = [c.name for c in rows.schema if c.name != "session"]
    newest = rows.groupBy("run_id").agg(F.max_by(F.struct(*names[1:]), "session").alias("_s"))
    return newest.select("run_id", "_s.*")
