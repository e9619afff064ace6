"""Substring dedup: windows of words that a smaller document has, behind a count-min prefilter.

1. Every pack of documents sketches its windows: how many documents of the pack fall into
   each cell.  Sketches are added up by cell range, one task a range; a cell with two or
   more documents is hot.  Cells overestimate, so no repeated window is in a cold one.
2. A second pass groups exactly, by a second hash of 64 bits, the windows in hot cells only.
   A pack asks once for each such window, with its smallest document; the answer says whether
   another pack holds it in a smaller document.
3. Words under a window with a smaller document go; the rest is joined by single spaces.

The sketch has a fixed greatest size (``MAX_CELL_BITS``), which bounds the bitmap of hot cells
that is broadcast: 2**30 bits, 128 MB.  A corpus too large for it makes more cells hot and so
loses some of the saving, never a window.

Defined cases: a null text has no words; rows that share an id are one document in
comparisons, each keeps its own words; null ids count as one document that comes last; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.durable import durable
from tidemark.llm import packs as P
from tidemark.llm import text as X
from tidemark.llm.line_dedup import LAST
from tidemark.llm.tables import picked, table

WINDOW = 13
#: Cells for each window that the text may have, and the greatest sketch, as powers of two.
CELL_BITS_MORE, MAX_CELL_BITS = 3, 30
WORDS_PER_BYTE = 0.18


def window_keys(texts, doc: np.ndarray, width: int):
    """(words, first word of each window, row, sketch hash, exact hash)."""
    data, off = X.text_buffer(texts)
    w = X.Words(data, off)
    at, row = w.windows(width)
    h = w.hashes()
    return w, at, row, X.window_hash(h, at, width, 3), X.window_hash(h, at, width, 4)


def _cells(hashes: np.ndarray, cell_bits: int) -> np.ndarray:
    return hashes >> X.U(64 - cell_bits)


def sketch(packs: DataFrame, cell_bits: int, bits: int, width: int) -> DataFrame:
    """(slice, hot): compressed bits of each cell range."""

    def of_pack(doc, held, texts):
        _, _, row, h, _ = window_keys(texts, doc, width)
        cell = _cells(h, cell_bits)
        order = np.lexsort((doc[row], cell))
        cell, d = cell[order], doc[row][order]
        new = np.ones(len(cell), bool)
        new[1:] = (cell[1:] != cell[:-1]) | (d[1:] != d[:-1])
        cells, count = np.unique(cell[new], return_counts=True)
        return cells << X.U(64 - cell_bits), np.minimum(count, 2).astype(X.U)

    def add_up(group: pa.Table) -> pa.Table:
        s = group.column("slice")[0].as_py()
        size = 1 << (cell_bits - bits)
        total = np.zeros(size, np.uint8)
        for keys, notes in zip(group.column("keys").to_pylist(), group.column("notes").to_pylist(), strict=True):
            cell = (P.spread_sorted(keys) >> X.U(64 - cell_bits)).astype(np.int64) - s * size
            total[cell] = np.minimum(total[cell] + P.spread(notes).astype(np.uint8), 2)
        hot = zlib.compress(np.packbits(total >= 2).tobytes(), 1)
        return pa.table({"slice": pa.array([s], pa.int32()), "hot": pa.array([hot], pa.binary())})

    return P.ask(packs, bits, of_pack).groupBy("slice").applyInArrow(add_up, "slice int, hot binary")


class Hot:
    """The bitmap of hot cells; opened once in each worker."""

    def __init__(self, parts: dict[int, bytes], cell_bits: int, bits: int):
        self.parts, self.cell_bits, self.bits, self.map = parts, cell_bits, bits, None

    def __getstate__(self):
        return {**self.__dict__, "map": None}

    def test(self, hashes: np.ndarray) -> np.ndarray:
        if self.map is None:
            each = 1 << (self.cell_bits - self.bits - 3)
            self.map = np.zeros(each << self.bits, np.uint8)
            for s, blob in self.parts.items():
                self.map[s * each : (s + 1) * each] = np.frombuffer(zlib.decompress(blob), np.uint8)
        cell = _cells(hashes, self.cell_bits).astype(np.int64)
        return (self.map[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 > 0


def _asked(doc: np.ndarray, row: np.ndarray, key: np.ndarray):
    """(distinct keys, smallest document of each, place of each window's key)."""
    keys, place = np.unique(key, return_inverse=True)
    least = np.full(len(keys), LAST, np.int64)
    np.minimum.at(least, place, doc[row])
    return keys, least, place


_SIGN = X.U(1 << 63)


def smaller_elsewhere(keys: np.ndarray, notes: np.ndarray):
    order = np.argsort(keys, kind="stable")
    k, n = keys[order], notes[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    least = np.minimum.reduceat(n, np.flatnonzero(new))[np.cumsum(new) - 1]
    out = np.zeros(len(keys), X.U)
    out[order] = (least < n).astype(X.U)
    return out, np.array([new.sum()], X.U)


def drop_repeats(docs: DataFrame, width: int = WINDOW, max_cell_bits: int = MAX_CELL_BITS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) for each row of ``docs``."""
    spark = docs.sparkSession
    base = picked(docs, doc_id="long", text="string")
    packs = P.pack(base.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.col("doc_id").isNull().alias("held"), "text"))
    bits = P.slice_bits(packs, WORDS_PER_BYTE)
    total = packs.agg(F.sum("n_bytes")).first()[0] or 0
    cell_bits = int(np.clip(np.ceil(np.log2(max(2, total * WORDS_PER_BYTE))) + CELL_BITS_MORE, bits + 3, max(max_cell_bits, bits + 3)))
    hot = spark.sparkContext.broadcast(
        Hot({r.slice: bytes(r.hot) for r in sketch(packs, cell_bits, bits, width).toLocalIterator()}, cell_bits, bits)
    )

    def of_pack(doc, held, texts):
        _, _, row, h, key = window_keys(texts, doc, width)
        use = hot.value.test(h)
        keys, least, _ = _asked(doc, row[use], key[use])
        return keys, least.view(X.U) ^ _SIGN

    answers = durable(P.answer(P.ask(packs, bits, of_pack), smaller_elsewhere), "answers")

    def rest(batches):
        for batch in batches:
            answers = batch.column("answers").to_pylist()
            for r, _, doc, null_id, texts in P.each_pack(batch):
                w, at, row, h, key = window_keys(texts, doc, width)
                use = hot.value.test(h)
                at, row = at[use], row[use]
                keys, least, place = _asked(doc, row, key[use])
                elsewhere = P.answers_of(answers[r]) > 0
                gone = elsewhere[place] | (doc[row] > least[place]) if len(keys) else np.zeros(0, bool)
                keep = ~X.covered(at[gone], width, len(w))
                n_removed = w.counts - X.row_sums(keep.astype(np.int64), w.first)
                kept = []
                for i, t in enumerate(texts.to_pylist()):
                    words = t.encode().split() if t else []
                    if n_removed[i]:
                        words = compress(words, keep[w.first[i] : w.first[i + 1]].tolist())
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc, mask=null_id),
                        pa.array(w.counts.astype(np.int64)),
                        pa.array(n_removed.astype(np.int64)),
                        pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
                        pa.array([x.decode() for x in kept], pa.string()),
                    ],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
                )

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    return P.answered(packs, answers).mapInArrow(rest, schema)


def op8_substring_dedup(spark, sf_dir):
    return drop_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


QUERIES = {"op8_substring_dedup": op8_substring_dedup}

ORACLES = {
    "op8_substring_dedup": rf"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
g as (select rid, doc_id, i, array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ') as s from d, unnest(range(1, len(w) - {WINDOW - 2})) as x(i)),
m as (select s, min(doc_id) as owner from g group by s having count(distinct doc_id) > 1),
r as (select distinct rid, j from (select rid, i from g join m using (s) where doc_id > owner), unnest(range(i, i + {WINDOW})) as y(j)),
k as (select rid, count(*) as n, list(j) as js from r group by rid),
wds as (select d.rid, j, w[j] as word from d, unnest(range(1, len(w) + 1)) as z(j)),
t as (select rid, string_agg(word, ' ' order by j) as kept from wds anti join r using (rid, j) group by rid)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join k using (rid) left join t using (rid)""",
}
