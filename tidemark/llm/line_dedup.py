"""Line dedup: range-partitioned line hashes, secondary sort, streamed first occurrences.

1. Every line's key (stripped, A-Z lower-cased) becomes a 128-bit hash with document and
   position; keys that are too short to count are left out.
2. The rows are range-partitioned and sorted by hash, document, position.  The range covers
   the whole sort key, so a line that a third of all documents hold spreads over many
   partitions.  Each task streams its partition and flags the lines that are not in their
   key's first document.
3. A key that starts in an earlier partition is undecided at the head of later ones.  Each
   partition reports its first and last key (two rows, however large it is); from these the
   carried first document of each head is known, and joined to the few head rows.
4. What is left per document is a compressed bitmap of lines to keep, never text.

Defined cases: a null or empty text is one empty line; rows that share an id are one document
when lines are compared, each keeps a bitmap of its own (told apart by a hash of the text);
null ids count as one document that comes last; other columns are ignored; empty tables work.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.durable import durable
from tidemark.llm import text as X
from tidemark.llm.quality_rules import line_spans
from tidemark.llm.tables import picked, table

#: Code points that a key needs to be compared at all.
MIN_KEY = 10
#: Stands for a null id: after all others.
LAST = (1 << 63) - 1

LINE = "h1 long, h2 long, doc long, mark long, pos int, n_lines int"
FLAG = "part int, kind int, h1 long, h2 long, doc long, mark long, pos int, n_lines int"
DROPPED, HEAD, FIRST, FINAL = range(4)


def line_hashes(batches):
    for batch in batches:
        for a, b, data, off in X.batches_of_text(batch):
            row, start, end, pos = line_spans(data, off)
            solid = np.flatnonzero(~X.SPACE[data])
            i, j = np.searchsorted(solid, start), np.searchsorted(solid, end)
            some = i < j
            row_n = np.bincount(row, minlength=b - a)
            row, pos, start, end = row[some], pos[some], solid[i[some]], solid[j[some] - 1] + 1
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            use = points[end] - points[start] >= MIN_KEY
            row, pos, start, end = row[use], pos[use], start[use], end[use]
            doc, mark = (np.asarray(batch.column(c).slice(a, b - a)) for c in ("doc", "mark"))
            h = [X.span_hash(data, start, end, s, X.LOWER).view(np.int64) for s in (11, 12)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (*h, doc[row], mark[row], pos.astype(np.int32), row_n[row].astype(np.int32))],
                ["h1", "h2", "doc", "mark", "pos", "n_lines"],
            )


def first_occurrences(batches):
    """Streams one sorted partition; the only state is the current key and its first document."""
    part = TaskContext.get().partitionId()
    key = head = None
    first = start = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc = (np.asarray(batch.column(c)) for c in ("h1", "h2", "doc"))
        n = len(h1)
        new = np.ones(n, bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new[0] = (h1[0], h2[0]) != key
        at = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        owner = np.where(at < 0, first if first is not None else 0, doc[np.maximum(at, 0)])
        if head is None:
            head, start = (int(h1[0]), int(h2[0])), int(doc[0])
        at_head = (h1 == head[0]) & (h2 == head[1])
        key, first = (h1[-1], h2[-1]), owner[-1]
        out = at_head | (doc != owner)
        kind = np.where(at_head, HEAD, DROPPED)[out]
        yield _flags(part, kind, *(np.asarray(batch.column(c))[out] for c in ("h1", "h2", "doc", "mark", "pos", "n_lines")))
    if head is not None:
        yield _flags(part, [FIRST, FINAL], [head[0], key[0]], [head[1], key[1]], [start, first], [0, 0], [0, 0], [0, 0])


def _flags(part, kind, *columns):
    kinds = [np.int64, np.int64, np.int64, np.int64, np.int32, np.int32]
    arrays = [pa.array(np.full(len(kind), part, np.int32)), pa.array(np.asarray(kind, np.int32))]
    arrays += [pa.array(np.asarray(c, k)) for c, k in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in FLAG.split(", ")])


def carried(ends: list) -> list[tuple[int, int, int]]:
    """(partition, hash half, first document) where a partition's head key began earlier."""
    by_part: dict[int, dict[int, object]] = {}
    for r in ends:
        by_part.setdefault(r.part, {})[r.kind] = r
    out, key, owner = [], None, None
    for part in sorted(by_part):
        first, final = by_part[part][FIRST], by_part[part][FINAL]
        going_on = key == (first.h1, first.h2)
        if going_on:
            out.append((part, owner))
        if (final.h1, final.h2) != (first.h1, first.h2) or not going_on:
            key, owner = (final.h1, final.h2), final.doc
    return out


def keyed(docs: DataFrame, **carry: str) -> DataFrame:
    return picked(docs, doc_id="long", text="string", **carry).select(
        "doc_id", "text", *carry, F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark")
    )


def pack_bits(batches):
    for batch in batches:
        bits = []
        for n, drop in zip(batch.column("n_lines").to_pylist(), batch.column("drop").to_pylist(), strict=True):
            keep = np.ones(n, bool)
            keep[drop] = False
            bits.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("mark"), pa.array(bits, pa.binary())], ["doc", "mark", "keep"])


def line_bitmaps(docs: DataFrame) -> DataFrame:
    """(doc, mark, keep): compressed bits of the lines to keep, for documents that lose any."""
    spark = docs.sparkSession
    lines = durable(keyed(docs).select("doc", "mark", "text").mapInArrow(line_hashes, LINE), "lines")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ("h1", "h2", "doc", "mark", "pos")
    flags = durable(
        lines.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(first_occurrences, FLAG), "line-flags"
    )
    # two rows for each range partition, whatever the partitions hold
    ends = flags.where(F.col("kind").isin(FIRST, FINAL)).select("part", "kind", "h1", "h2", "doc").collect()
    heads = spark.createDataFrame(carried(ends), "part int, owner long")
    late = flags.where(F.col("kind") == HEAD).join(heads, "part").where("doc <> owner")
    # a head that began in its own partition still has its own first document
    own = (
        flags.where(F.col("kind") == HEAD)
        .join(flags.where(F.col("kind") == FIRST).select("part", F.col("doc").alias("owner")), "part")
        .where("doc <> owner")
    )
    pick = ("doc", "mark", "pos", "n_lines")
    dropped = flags.where(F.col("kind") == DROPPED).select(*pick).union(late.select(*pick)).union(own.select(*pick))
    per_doc = dropped.groupBy("doc", "mark").agg(F.collect_set("pos").alias("drop"), F.max("n_lines").alias("n_lines"))
    return per_doc.mapInArrow(pack_bits, "doc long, mark long, keep binary")


def kept_lines(text: str | None, keep: bytes | None) -> tuple[int, int, str]:
    lines = (text or "").split("\n")
    if keep is None:
        return len(lines), 0, text or ""
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    left = [x for x, k in zip(lines, bits, strict=True) if k]
    return len(lines), len(lines) - len(left), "\n".join(left)


KEPT = "doc_id long, n_lines long, n_dropped long, kept_sha256 string, kept_text string"


def _apply_bitmaps(carry):
    def run(batches):
        for batch in batches:
            texts = [kept_lines(*x) for x in zip(batch.column("text").to_pylist(), batch.column("keep").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([x[0] for x in texts], pa.int64()),
                    pa.array([x[1] for x in texts], pa.int64()),
                    pa.array([hashlib.sha256(x[2].encode()).hexdigest() for x in texts], pa.string()),
                    pa.array([x[2] for x in texts], pa.string()),
                    *(batch.column(c) for c in carry),
                ],
                [*(x.split()[0] for x in KEPT.split(", ")), *carry],
            )

    return run


def dedup_lines(docs: DataFrame, **carry: str) -> DataFrame:
    """Each document with its counts, the hash of what stays, and the text that stays; ``carry``
    names further columns to return, with their types."""
    joined = keyed(docs, **carry).join(line_bitmaps(docs), ["doc", "mark"], "left").select("doc_id", "text", "keep", *carry)
    return joined.mapInArrow(_apply_bitmaps(list(carry)), KEPT + "".join(f", {k} {t}" for k, t in carry.items()))


def op5_line_dedup(spark, sf_dir):
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


QUERIES = {"op5_line_dedup": op5_line_dedup}

ORACLES = {
    "op5_line_dedup": rf"""
with d as (select row_number() over () as rid, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select rid, doc_id, i, ls[i] as line,
    translate(regexp_replace(ls[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from d, unnest(range(1, len(ls) + 1)) as x(i)),
f as (select k, min(doc_id) as owner from l where length(k) >= {MIN_KEY} group by k having count(distinct doc_id) > 1),
j as (select l.*, f.k is not null and l.doc_id <> f.owner as dropped from l left join f using (k))
select doc_id, count(*) as n_lines, cast(count(*) filter (dropped) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (not dropped), '')) as kept_sha256
from j group by rid, doc_id""",
}
