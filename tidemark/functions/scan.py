"""Skew-safe running state over an ordered tape.

A plain ``Window.partitionBy(symbol)`` puts a hot symbol into one task.  Every
print-level running value here is computed in two levels instead:

* *local* part: a running frame inside one short time chunk of one key, so a hot
  key spreads over as many tasks as it has chunks;
* *carry* part: one summary row per (key, chunk), scanned over the key.  That scan
  sees at most (key duration / chunk width) rows however many prints there are.

The two meet in an equi-join on (key, chunk), whose big side keeps the
partitioning that the local window already produced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Rows of one key that a chunk of a numeric order holds at most.
ROW_CHUNK = 4096


@dataclass(frozen=True)
class Running:
    """One running value: ``kind`` is sum, max, min, first or last (nulls are skipped)."""

    name: str
    kind: str
    value: Column
    inclusive: bool = True


def _fold(kind: str, value: Column, order: Column) -> Column:
    if kind == "sum":
        return F.sum(value)
    if kind == "max":
        return F.max(value)
    if kind == "min":
        return F.min(value)
    present = F.when(value.isNotNull(), order)
    return F.max_by(value, present) if kind == "last" else F.min_by(value, present)


def _over(kind: str, value: Column, window) -> Column:
    if kind in ("sum", "max", "min"):
        return getattr(F, kind)(value).over(window)
    return getattr(F, kind)(value, ignorenulls=True).over(window)


def _join(kind: str, carry: Column, local: Column) -> Column:
    if kind == "sum":
        return F.when(
            carry.isNotNull() | local.isNotNull(),
            F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0)),
        )
    if kind == "max":
        return F.greatest(carry, local)
    if kind == "min":
        return F.least(carry, local)
    return F.coalesce(local, carry) if kind == "last" else F.coalesce(carry, local)


def running(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    order: Sequence[str],
    specs: Sequence[Running],
    order_value: Column | None = None,
    initial: DataFrame | None = None,
) -> DataFrame:
    """Add running values per ``keys`` in ``order``; ``chunk`` must rise with ``order``.

    ``order_value`` is the same order as one number (see ``expr.order_key``); with it and
    plain values the per-chunk summary of first/last is a hash aggregate.  ``initial`` has a
    row per key with what was known before its first row, in columns named like the values
    that it starts; values without such a column start empty."""
    keys, order = list(keys), list(order)
    ordering = F.struct(*order) if order_value is None else order_value
    part = W.partitionBy(*keys, chunk).orderBy(*order)
    upto = part.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = part.rowsBetween(W.unboundedPreceding, -1)

    local = df.select(
        "*",
        *[
            _over(s.kind, s.value, upto if s.inclusive else before).alias(f"_l_{s.name}")
            for s in specs
        ],
    )
    summary = (
        df.withColumn("_o", ordering)
        .groupBy(*keys, chunk)
        .agg(*[_fold(s.kind, s.value, F.col("_o")).alias(f"_s_{s.name}") for s in specs])
    )
    earlier = W.partitionBy(*keys).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    carry = summary.select(
        *keys,
        chunk,
        *[_over(s.kind, F.col(f"_s_{s.name}"), earlier).alias(f"_c_{s.name}") for s in specs],
    )
    if initial is not None:
        starts = {s.name: F.col(f"_i_{s.name}") for s in specs if s.name in initial.columns}
        rows = initial.select(*keys, *[F.col(n).alias(f"_i_{n}") for n in starts])
        carry = carry.join(rows, keys, "left").select(
            *keys,
            chunk,
            *[
                (_join(s.kind, starts[s.name], c) if s.name in starts else c).alias(f"_c_{s.name}")
                for s in specs
                for c in [F.col(f"_c_{s.name}")]
            ],
        )
    joined = local.join(carry, [*keys, chunk], "left")
    return joined.select(
        *df.columns,
        *[
            _join(s.kind, F.col(f"_c_{s.name}"), F.col(f"_l_{s.name}")).alias(s.name)
            for s in specs
        ],
    )


def asof_rows(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ts: str,
    right_ts: str,
    values: Sequence[str],
    strict: bool = False,
) -> DataFrame:
    """Attach the latest ``right`` row at or before each ``left`` row.

    For *bar-level* tables, whose rows per key are bounded by the time grid: one
    union, one shuffle, one sort."""
    keys = list(keys)
    packed = F.struct(*[F.col(v) for v in values])
    lhs = left.select(
        *left.columns,
        F.col(left_ts).alias("_at"),
        F.lit(0 if strict else 1).alias("_side"),
        F.lit(True).alias("_keep"),
    )
    rhs = right.select(
        *keys,
        F.col(right_ts).alias("_at"),
        F.lit(1 if strict else 0).alias("_side"),
        F.lit(False).alias("_keep"),
        packed.alias("_r"),
    )
    both = lhs.unionByName(rhs, allowMissingColumns=True)
    w = W.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, 0)
    out = both.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).filter("_keep")
    return out.select(*left.columns, *[F.col(f"_r.{v}").alias(v) for v in values])


def halo(df: DataFrame, ts: str, chunk_us: int, back_us: int, out: str) -> DataFrame:
    """Copy rows near a chunk's end into the chunks that look back at them.

    Adds ``out`` (chunk start) and ``_own`` (true in the row's own chunk), so a RANGE
    frame reaching ``back_us`` back can be partitioned by chunk.  The copy factor is
    1 + back_us / chunk_us, whatever the key distribution."""
    own = F.col(ts) - F.pmod(F.col(ts), F.lit(chunk_us))
    last = F.col(ts) + F.lit(back_us)
    last = last - F.pmod(last, F.lit(chunk_us))
    spread = df.withColumn(out, F.explode(F.sequence(own, last, F.lit(chunk_us))))
    return spread.withColumn("_own", F.col(out) == own)


def ewma(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: Column,
    alpha: float,
    out: str,
    initial: DataFrame | None = None,
    chunk: str | None = None,
) -> DataFrame:
    """Exponential average whose first value is the first input, or which goes on from
    ``initial``: a row per key with the average so far in a column named ``out``.

    Each step is the map y -> keep * y + alpha * x, and such maps compose.  Rows are cut into
    blocks by their number; inside a block the composition is a weighted prefix sum, its size
    keeping the weights inside double range.  Over a whole block the old value's weight is
    e^-600, below what a double can add, so a block starts from the end of the one before it:
    one row for each block, met on equality.

    Bar-level tables are numbered by a window over the key; with ``chunk``, a column that rises
    with ``order``, numbering is a chunked scan too, and a key with all rows is split."""
    keys = list(keys)
    block = max(int(600 / -math.log(1.0 - alpha)), 1)
    keep = 1.0 - alpha
    rows = df.withColumn("_x", value.cast("double"))
    if chunk is None:
        whole = W.partitionBy(*keys).orderBy(order)
        rows = rows.withColumn("_i", F.row_number().over(whole) - 1).withColumn("_x0", F.first("_x").over(whole))
    else:
        specs = [Running("_i", "sum", F.lit(1).cast("bigint")), Running("_x0", "first", F.col("_x"))]
        rows = running(rows, keys, chunk, [order], specs).withColumn("_i", F.col("_i") - 1)
    if initial is not None:
        rows = rows.join(initial.select(*keys, F.col(out).alias("_start")), keys, "left")
        rows = rows.withColumn("_x0", F.coalesce("_start", "_x0")).drop("_start")
    rows = rows.withColumn("_b", F.floor(F.col("_i") / block)).withColumn("_p", F.col("_i") % block)
    inside = W.partitionBy(*keys, "_b").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    scaled = F.col("_x") * F.pow(F.lit(keep), -F.col("_p"))
    rows = rows.withColumn(
        "_l", F.sum(scaled).over(inside) * F.pow(F.lit(keep), F.col("_p")) * F.lit(alpha)
    )
    ends = rows.groupBy(*keys, (F.col("_b") + 1).alias("_b")).agg(
        F.max("_p").alias("_n"), F.max_by("_l", "_p").alias("_e")
    )
    # the first block's start still shows in the second's when blocks are short of e^-600
    start = F.when(F.col("_b") == 0, F.col("_x0")).otherwise(
        F.col("_e") + F.when(F.col("_b") == 1, F.pow(F.lit(keep), F.col("_n") + 1) * F.col("_x0")).otherwise(0.0)
    )
    done = rows.join(ends, [*keys, "_b"], "left")
    return done.select(
        *df.columns, (F.pow(F.lit(keep), F.col("_p") + 1) * start + F.col("_l")).alias(out)
    )


#: Clamped steps: beyond this factor every value in bounds ends at a bound.
FAR = 1e9


def _composed(keys: Sequence[str]):
    """Prefix composition of the steps m -> min(max(m * f, lo), hi) in rows sorted by ``keys``:
    doubling spans in each batch, one step carried to the next batch."""
    keys = list(keys)

    def after(a, b):
        f = np.clip(a[0] * b[0], 1 / FAR, FAR)
        return f, *(np.minimum(np.maximum(x * b[0], b[1]), b[2]) for x in a[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, here = None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            names = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            new = np.array([True, *(names[i] != names[i - 1] for i in range(1, n))])
            begin = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            step = tuple(np.array(batch.column(c)) for c in ("_f", "_lo", "_hi"))
            span = 1
            while span < n:
                at = np.flatnonzero(np.arange(n) - begin >= span)
                if not len(at):
                    break
                both = after(tuple(x[at - span] for x in step), tuple(x[at] for x in step))
                for x, y in zip(step, both, strict=True):
                    x[at] = y
                span *= 2
            if here == names[0]:
                first = begin == 0
                both = after(carried, tuple(x[first] for x in step))
                for x, y in zip(step, both, strict=True):
                    x[first] = y
            carried, here = tuple(x[-1:] for x in step), names[-1]
            columns = [pa.array(x) if c in ("_f", "_lo", "_hi") else batch.column(c) for c, x in _aligned(batch, step)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return run


def _aligned(batch: pa.RecordBatch, step):
    by_name = dict(zip(("_f", "_lo", "_hi"), step, strict=True))
    return [(c, by_name.get(c)) for c in batch.schema.names]


def compose(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Replace each row's step (_f, _lo, _hi) by the composition of all its key's up to it."""
    rows = df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, order)
    return rows.mapInArrow(_composed(keys), df.schema)


def clamped_ends(df: DataFrame, keys: Sequence[str], chunk: str, order: str, factor: Column, low: float, high: float) -> tuple[DataFrame, DataFrame]:
    """Rows with the composed step of their chunk up to them, and one row a chunk with the whole's."""
    bounds = {"_f": factor, "_lo": F.lit(low), "_hi": F.lit(high)}
    local = compose(df.withColumns(bounds), [*keys, chunk], order)
    last = [F.max_by(c, order).alias(c) for c in bounds]
    return local, local.groupBy(*keys, chunk).agg(*last)


def _apply(value: Column) -> Column:
    return F.least(F.greatest(value * F.col("_f"), F.col("_lo")), F.col("_hi"))


def clamped(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    order: str,
    factor: Column,
    low: float,
    high: float,
    out: str,
    initial: DataFrame | None = None,
) -> DataFrame:
    """Running product of ``factor`` per key from 1.0, clamped to [low, high] after every row.

    The clamp makes order matter, but the steps compose to the same form, so a key is split
    into chunks: composed inside each, one row a chunk composed over the key, joined on equality.
    ``initial``: a row per key with the product so far in a column named ``out``."""
    keys = list(keys)
    local, ends = clamped_ends(df, keys, chunk, order, factor, low, high)
    whole = compose(ends, keys, chunk)
    before = W.partitionBy(*keys).orderBy(chunk)
    carry = whole.select(*keys, chunk, *[F.lag(c).over(before).alias(f"_c{c}") for c in ("_f", "_lo", "_hi")])
    start = F.lit(1.0)
    if initial is not None:
        carry = carry.join(initial.select(*keys, F.col(out).alias("_start")), keys, "left")
        start = F.coalesce("_start", F.lit(1.0))
    moved = F.least(F.greatest(start * F.col("_c_f"), F.col("_c_lo")), F.col("_c_hi"))
    carry = carry.select(*keys, chunk, F.when(F.col("_c_f").isNull(), start).otherwise(moved).alias("_from"))
    return local.join(carry, [*keys, chunk]).select(*df.columns, _apply(F.col("_from")).alias(out))


def clamped_last(df: DataFrame, keys: Sequence[str], chunk: str, order: str, factor: Column, low: float, high: float, out: str) -> DataFrame:
    """The value of ``clamped`` at each key's last row."""
    keys = list(keys)
    _, ends = clamped_ends(df, keys, chunk, order, factor, low, high)
    last = compose(ends, keys, chunk).groupBy(*keys).agg(*[F.max_by(c, chunk).alias(c) for c in ("_f", "_lo", "_hi")])
    return last.select(*keys, _apply(F.lit(1.0)).alias(out))
