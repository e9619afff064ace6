"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the benchmark's windows of words, the symbols are words.  For each pattern
length a shift table over blocks of neighbouring words says how far the search may jump; a
block that ends some pattern has shift 0 and leads to a bucket of patterns with that suffix,
and only direct comparison of the words makes an occurrence.

The benchmark is a stated query set.  Its windows are cut into blocks of at most
``block_windows`` patterns, so what one pass over the documents broadcasts is bounded; a
larger benchmark takes more passes, each adding to the hits found so far.  Documents are
never shuffled.

Defined cases: a null or wordless text or item has no words and no windows; repeated rows
are searched alike; repeated item ids count once; null item ids never match; other columns
are ignored; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.durable import durable
from tidemark.llm import text as X
from tidemark.llm.tables import picked, table

WINDOW = 10
#: Words in a block of the shift table.
BLOCK = 3
#: Patterns of one pass; at about 200 bytes each this bounds what is broadcast.
BLOCK_WINDOWS = 100_000

_TO_WORDS = bytes(int(c) if not X.NOT_ALNUM[c] else 32 for c in X.LOWER)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of letters, digits and all that is not ASCII."""
    return text.encode().translate(_TO_WORDS).split() if text else []


def item_windows(batches):
    for batch in batches:
        items, windows = [], []
        for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            w = words_of(text)
            if not w or item is None:
                continue
            size = min(WINDOW, len(w))
            for i in range(len(w) - size + 1):
                items.append(item)
                windows.append(b" ".join(w[i : i + size]).decode())
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(windows, pa.string())], ["item_id", "window"])


class WuManber:
    """Patterns of one length."""

    def __init__(self, size: int, patterns: dict[tuple[bytes, ...], list[str]]):
        self.size, self.block = size, min(BLOCK, size)
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], list[tuple[tuple[bytes, ...], list[str]]]] = defaultdict(list)
        for pattern, items in patterns.items():
            for end in range(self.block, size + 1):
                b = pattern[end - self.block : end]
                self.shift[b] = min(self.shift.get(b, size), size - end)
            self.bucket[pattern[-self.block :]].append((pattern, items))

    def search(self, words: list[bytes], hit: np.ndarray, found: set[str]) -> None:
        size, block, shift, bucket = self.size, self.block, self.shift, self.bucket
        jump, end, n = size - block + 1, size, len(words)
        get = shift.get
        while end <= n:
            tail = tuple(words[end - block : end])
            step = get(tail, jump)
            if step:
                end += step
                continue
            here = None
            for pattern, items in bucket[tail]:
                here = here or tuple(words[end - size : end])
                if pattern == here:
                    hit[end - size : end] = True
                    found.update(items)
            end += 1


def matchers(rows: list) -> list[WuManber]:
    by_size: dict[int, dict] = defaultdict(lambda: defaultdict(list))
    for r in rows:
        w = tuple(r.window.encode().split(b" "))
        by_size[len(w)][w].append(r.item_id)
    return [WuManber(size, patterns) for size, patterns in sorted(by_size.items())]


def _search(shared, carry):
    def run(batches):
        patterns = shared.value
        for batch in batches:
            spans, items, sizes = [], [], []
            for text, old, had in zip(*(batch.column(c).to_pylist() for c in ("text", "spans", "items")), strict=True):
                w = words_of(text)
                hit, found = np.zeros(len(w), bool), set(had or ())
                if old:
                    hit[np.frombuffer(old, np.uint32)] = True
                for m in patterns:
                    m.search(w, hit, found)
                sizes.append(len(w))
                spans.append(np.flatnonzero(hit).astype(np.uint32).tobytes())
                items.append(sorted(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text"), pa.array(sizes, pa.int64()), pa.array(spans, pa.binary()), pa.array(items, pa.list_(pa.string())), *(batch.column(c) for c in carry)],
                ["doc_id", "text", "n_words", "spans", "items", *carry],
            )

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, block_windows: int = BLOCK_WINDOWS, **carry: str) -> DataFrame:
    """Documents with the places of hit words (uint32 each) and the items that occur in them;
    ``carry`` names further columns to return, with their types."""
    spark = docs.sparkSession
    windows = picked(benchmark, item_id="string", text="string").mapInArrow(item_windows, "item_id string, window string").distinct()
    windows = durable(windows, "windows")
    passes = max(1, -(-windows.count() * 5 // (block_windows * 4)))
    windows = windows.withColumn("pass", F.pmod(F.xxhash64("window", "item_id"), F.lit(passes)))
    schema = "doc_id long, text string, n_words long, spans binary, items array<string>" + "".join(f", {k} {t}" for k, t in carry.items())
    out = picked(docs, doc_id="long", text="string", **carry).select(
        "doc_id", "text", F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("binary").alias("spans"), F.lit(None).cast("array<string>").alias("items"), *carry
    )
    for k in range(passes):
        block = windows.where(F.col("pass") == k).select("item_id", "window").collect()  # bounded: one block
        shared = spark.sparkContext.broadcast(matchers(block))
        out = out.mapInArrow(_search(shared, list(carry)), schema)
        if k + 1 < passes:
            out = durable(out, "hits")
    return out


def op1_decontaminate(spark, sf_dir):
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = (F.length("spans") / 4).cast("long")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def sha_of(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


QUERIES = {"op1_decontaminate": op1_decontaminate}

_SPLIT = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES = {
    "op1_decontaminate": rf"""
with d as (select row_number() over () as rid, doc_id, {_SPLIT} as w from documents),
b as (select cast(item_id as varchar) as item, {_SPLIT} as w from benchmark where item_id is not null),
win as (select distinct item, n, list_slice(w, i, i + n - 1) as s from
  (select item, w, cast(least({WINDOW}, len(w)) as bigint) as n from b where len(w) > 0) as q, unnest(range(1, len(w) - n + 2)) as x(i)),
g as (select rid, i, z.n, list_slice(w, i, i + z.n - 1) as s
  from d, (select distinct n from win) as z, unnest(range(1, len(w) - z.n + 2)) as x(i)),
m as (select rid, i, g.n, item from g join win using (n, s)),
hit as (select rid, count(distinct j) as n_hit from m, unnest(range(i, i + n)) as y(j) group by rid),
it as (select rid, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from m group by rid)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (rid) left join it using (rid)""",
}
