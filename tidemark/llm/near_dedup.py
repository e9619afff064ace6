"""Near-dedup with min-max hashing and exact confirmation.

1. Signatures: each permutation of a document's shingle hashes gives its smallest and its
   largest value, so ``BANDS * ROWS`` values cost half as many evaluations.  Bands of ``ROWS``
   values become keys.  At a similarity of exactly 0.8 two documents miss every band with a
   probability below 1e-6, and the true groups rarely hang on one pair.
2. Documents with equal sets are one class, named by its smallest id; only class names go on.
3. In a band bucket everyone is tied to the smallest id: a star, not all pairs.  Connected
   components of these ties are clusters of candidates: every link that the bands can find
   lies inside one cluster.
4. Inside a cluster links are confirmed on full shingle sets.  A task searches breadth-first:
   each member meets all that are not yet reached, at one pass over their shingles, and only
   the links that reach somebody are returned, at most one for each member.  A cluster of
   more than ``CLUSTER_SHINGLES`` is cut into chunks, and each pair of chunks is a task: memory
   is bounded, every pair of members still meets.
5. Components of the confirmed links name the groups.

Defined cases: texts without words have an empty set and no links; ids may repeat (rows of
one id are one node for links, each row is returned); rows without an id take part in no link,
their component is that of an equal set, else null, and then they are kept; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.durable import durable
from tidemark.llm import text as X
from tidemark.llm.tables import components, picked, table

#: Words in a shingle and the least similarity in percent, unless a caller says otherwise.
SHINGLE, PERCENT = 5, 80
BANDS, ROWS = 48, 6
#: Shingles of one confirming task, times two for a pair of chunks.
CLUSTER_SHINGLES = 2_000_000


def shingle_sets(words: X.Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every distinct shingle, by row; a short text is one shingle."""
    h = words.hashes(table=X.LOWER)
    at, row = words.windows(width)
    values = X.window_hash(h, at, width)
    few = np.flatnonzero((words.counts > 0) & (words.counts < width))
    if len(few):
        short = [X.window_hash(h, words.first[few[words.counts[few] == n]], n) for n in range(1, width)]
        short_row = [few[words.counts[few] == n] for n in range(1, width)]
        values = np.concatenate([values, *short])
        row = np.concatenate([row, *short_row])
    order = np.lexsort((values, row))
    row, values = row[order], values[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (values[1:] != values[:-1])
    return row[new], values[new]


def permutations(bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    n = bands * rows // 2
    return rng.integers(0, 1 << 32, n, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, np.uint32)


def min_max(values: np.ndarray, first: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band keys (rows x bands) of the sets values[first[i]:first[i+1]], none of them empty."""
    low = values.astype(np.uint32)
    a, b = permutations(bands, rows)
    out = np.empty((2 * len(a), len(first) - 1), np.uint32)
    for k in range(len(a)):
        p = low * a[k] + b[k]
        out[2 * k] = np.minimum.reduceat(p, first[:-1])
        out[2 * k + 1] = np.maximum.reduceat(p, first[:-1])
    keys = np.zeros((bands, len(first) - 1), X.U)
    for k in range(bands):
        for r in range(rows):
            keys[k] = X.mix(keys[k] + out[k * rows + r].astype(X.U) + X.U(0x9E3779B97F4A7C15))
        keys[k] ^= X.U(k)
    return keys.T


def _signatures(width: int):
    def run(batches):
        for batch in batches:
            for i, j, data, off in X.batches_of_text(batch):
                n = j - i
                row, values = shingle_sets(X.Words(data, off), width)
                size = np.bincount(row, minlength=n)
                full = np.flatnonzero(size)
                first = np.concatenate([[0], np.cumsum(size[full])])
                bands = np.zeros((n, BANDS), np.int64)
                marks = np.zeros((2, n), np.int64)
                if len(full):
                    bands[full] = min_max(values, first, BANDS, ROWS).view(np.int64)
                    for k in (0, 1):
                        marks[k, full] = np.add.reduceat(X.mix(values + X.U(k * 977 + 1)), first[:-1]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, n),
                        pa.array(size.astype(np.int64)),
                        pa.array(marks[0]),
                        pa.array(marks[1]),
                        pa.ListArray.from_arrays(np.arange(0, (n + 1) * BANDS, BANDS, dtype=np.int32), bands.ravel()),
                    ],
                    ["doc_id", "n_shingles", "m1", "m2", "bands"],
                )

    return run


class Sets:
    """Shingle sets of some documents, with their shingles numbered."""

    def __init__(self, table: pa.Table, width: int):
        self.ids = np.asarray(table.column("doc_id"))
        data, off = X.text_buffer(table.column("text"))
        rows, values, base = [], [], 0
        for i, j in X.row_slices(off):
            r, v = shingle_sets(X.Words(data[off[i] : off[j]], off[i : j + 1] - off[i]), width)
            rows.append(r + i)
            values.append(v)
        row = np.concatenate(rows) if rows else np.empty(0, np.int64)
        _, self.shingle = np.unique(np.concatenate(values) if values else np.empty(0, X.U), return_inverse=True)
        self.size = np.bincount(row, minlength=len(self.ids))
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        self.known = int(self.shingle.max()) + 1 if len(self.shingle) else 0

    def of(self, i: int) -> np.ndarray:
        return self.shingle[self.first[i] : self.first[i + 1]]

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[rows]
        first = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.first[rows] - first[:-1], size) + np.arange(first[-1])
        return self.shingle[at], first


def spanning_links(sets: Sets, percent: int) -> list[tuple[int, int]]:
    """A forest of true links that connects what true links connect."""
    order = np.argsort(sets.size, kind="stable")
    left = order[sets.size[order] > 0]
    links, seen = [], np.zeros(sets.known, bool)
    while len(left):
        queue, left = [int(left[-1])], left[:-1]
        flat, first = sets.gather(left)
        while queue and len(left):
            i = queue.pop()
            n = int(sets.size[i])
            # sizes that a similarity of `percent` allows; `left` is sorted by size
            lo = int(np.searchsorted(sets.size[left], -(-n * percent // 100)))
            hi = int(np.searchsorted(sets.size[left], n * 100 // percent, "right"))
            if lo == hi:
                continue
            seen[sets.of(i)] = True
            total = np.concatenate([[0], np.cumsum(seen[flat[first[lo] : first[hi]]])])
            seen[sets.of(i)] = False
            edge = first[lo : hi + 1] - first[lo]
            both = total[edge[1:]] - total[edge[:-1]]
            found = 100 * both >= percent * (n + sets.size[left[lo:hi]] - both)
            if found.any():
                new = left[lo:hi][found]
                queue += new.tolist()
                links += [(int(sets.ids[i]), int(sets.ids[k])) for k in new]
                stay = np.ones(len(left), bool)
                stay[lo:hi] = ~found
                left = left[stay]
                flat, first = sets.gather(left)
    return links


def _confirm(width: int, percent: int):
    def run(group: pa.Table) -> pa.Table:
        links = spanning_links(Sets(group, width), percent)
        a, b = np.array(links, np.int64).reshape(-1, 2).T
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return run


def near_groups(
    docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT, cluster_shingles: int = CLUSTER_SHINGLES
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text)."""
    base = picked(docs, doc_id="long", text="string")
    sig = durable(base.mapInArrow(_signatures(width), "doc_id long, n_shingles long, m1 long, m2 long, bands array<long>"), "signatures")
    some = sig.where("n_shingles > 0 and doc_id is not null")
    classes = durable(
        some.groupBy("m1", "m2").agg(F.min("doc_id").alias("name"), F.min_by("bands", "doc_id").alias("bands"), F.max("n_shingles").alias("n")),
        "classes",
    )
    keyed = classes.select("name", F.explode("bands").alias("band"))
    hubs = keyed.groupBy("band").agg(F.min("name").alias("hub"), F.count("*").alias("k")).where("k > 1").select("band", "hub")
    ties = keyed.join(hubs, "band").where("name <> hub").select(F.col("name").alias("a"), F.col("hub").alias("b")).distinct()
    cluster = components(ties)
    members = classes.select("name", "n").join(cluster, F.col("name") == F.col("node")).select("name", "n", "root")
    weight = members.groupBy("root").agg(F.sum("n").alias("weight"))
    chunks = F.ceil(F.col("weight") / F.lit(cluster_shingles)).cast("int")
    own = F.pmod(F.xxhash64("name"), F.col("chunks")).cast("int")
    dealt = (
        members.join(weight, "root")
        .withColumn("chunks", chunks)
        .withColumn("own", own)
        .select(
            F.col("name").alias("doc_id"),
            "root",
            # a chunk meets itself and every other chunk
            F.explode(
                F.when(F.col("chunks") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
                    F.transform(
                        F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: c != F.col("own")),
                        lambda c: F.struct(F.least("own", c).alias("i"), F.greatest("own", c).alias("j")),
                    )
                )
            ).alias("task"),
        )
    )
    # ids may repeat in docs; any row of the class will do, equal sets or not all rows take part
    work = base.where("doc_id is not null").join(dealt, "doc_id").select("root", "task", "doc_id", "text")
    links = durable(
        work.groupBy("root", "task").applyInArrow(_confirm(width, percent), "a long, b long").where("a <> b").distinct(), "confirmed"
    )
    groups = components(links)
    named = classes.select("m1", "m2", "name").join(groups, F.col("name") == F.col("node"), "left").select(
        "m1", "m2", F.coalesce("root", "name").alias("root")
    )
    out = sig.select("doc_id", "n_shingles", "m1", "m2").join(named, ["m1", "m2"], "left")
    found = F.when(F.col("n_shingles") > 0, F.col("root")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", found.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    )


def op3_near_dedup(spark, sf_dir):
    return near_groups(table(spark, sf_dir, "documents"), width=4, percent=80)


QUERIES = {"op3_near_dedup": op3_near_dedup}

_LOWER = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
ORACLES = {
    "op3_near_dedup": rf"""
with recursive d as (select doc_id, {_LOWER} as w from documents),
s as (select distinct doc_id, list_slice(w, i, i + least(4, len(w)) - 1) as g
  from d, unnest(range(1, greatest(len(w) - 2, 2))) as x(i) where len(w) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b using (g) where a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 80 * (x.n + y.n - common)),
e as (select a, b from l union select b, a from l),
r(doc_id, c) as (select doc_id, doc_id from d union select e.b, r.c from r join e on e.a = r.doc_id where r.c < e.b),
m as (select doc_id, min(c) as component_id from r group by doc_id)
select d.doc_id, coalesce(n, 0) as n_shingles, component_id, d.doc_id = component_id as kept
from d join m using (doc_id) left join n using (doc_id)""",
}
