"""Packs of documents that ask questions about hashed keys.

Some operators must learn something about every word or window of every document: a count
over the corpus, whether a smaller document has it.  A row for each occurrence would be many
times the text.  Instead documents are packed, about half a megabyte of text to a row, and

* a pack asks once for each distinct key, in compressed lists cut by hash range (``slice``);
* one task a slice sees the lists of all packs and answers in the order asked;
* the answers, a bit or a small number a key, are joined to the packs.

A key that every document holds is one entry a pack, so no key makes a large group, and slices
are even because they are ranges of hashes.  Packs and lists live in Spark tables only.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.durable import stage_root
from tidemark.llm import text as X

PACK_BYTES = 1 << 19
#: Keys (before packs drop their repeats) that one slice takes at most, about.
SLICE_KEYS = 4_000_000
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def pack(docs: DataFrame, size: int = PACK_BYTES) -> DataFrame:
    """(pack, doc, held, text, n_bytes) from (doc, held, text); arrays, one row a pack; written once."""
    import uuid

    spark = docs.sparkSession
    if spark.conf.get(BATCH, None) in (None, str((1 << 31) - 1)):
        spark.conf.set(BATCH, str(32 << 20))  # rows are large, so batches are cut by bytes

    def run(batches):
        base, k = TaskContext.get().partitionId() << 32, 0
        held: list[pa.RecordBatch] = []
        weight = 0
        for batch in batches:
            _, off = X.text_buffer(batch.column("text"))
            for i, j in X.row_slices(off, size):
                held.append(batch.slice(i, j - i))
                weight += int(off[j] - off[i])
                if weight >= size // 2:
                    yield _row(base + k, held, weight)
                    k, held, weight = k + 1, [], 0
        if held:
            yield _row(base + k, held, weight)

    schema = "pack long, doc array<long>, held array<boolean>, text array<string>, n_bytes long"
    path = f"{stage_root(spark)}/tidemark/packs-{uuid.uuid4().hex}"
    out = docs.select("doc", "held", "text").mapInArrow(run, schema)
    out.write.option("compression", "zstd").option("parquet.block.size", str(16 << 20)).parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def _row(k: int, held: list[pa.RecordBatch], weight: int) -> pa.RecordBatch:
    t = pa.Table.from_batches(held)
    cols = [pa.array([k], pa.int64())]
    for name, kind in (("doc", pa.int64()), ("held", pa.bool_()), ("text", pa.string())):
        values = t.column(name).combine_chunks()
        values = values if isinstance(values, pa.Array) else pa.concat_arrays(values.chunks)
        cols.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(kind)))
    return pa.RecordBatch.from_arrays([*cols, pa.array([weight], pa.int64())], ["pack", "doc", "held", "text", "n_bytes"])


def each_pack(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, pa.Array]]:
    """(row, pack, docs, held, texts) of a batch of packs."""
    packs = batch.column("pack").to_pylist()
    cols = [batch.column(c) for c in ("doc", "held", "text")]
    for r, k in enumerate(packs):
        doc, held, texts = (c[r].values for c in cols)
        yield r, k, np.asarray(doc), held.to_numpy(zero_copy_only=False).astype(bool), texts


def squeeze(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes (equal high bytes cost nothing)."""
    v = np.ascontiguousarray(values, "<u8")
    planes = v.view(np.uint8).reshape(len(v), 8).T
    used = 8
    while used > 1 and len(v) and not planes[used - 1].any():
        used -= 1
    return bytes([used]) + len(v).to_bytes(4, "little") + zlib.compress(planes[:used].tobytes(), 1)


def spread(blob: bytes) -> np.ndarray:
    used, n = blob[0], int.from_bytes(blob[1:5], "little")
    out = np.zeros((n, 8), np.uint8)
    out[:, :used] = np.frombuffer(zlib.decompress(blob[5:]), np.uint8).reshape(used, n).T
    return out.reshape(-1).view("<u8").astype(X.U)


def squeeze_sorted(values: np.ndarray) -> bytes:
    return squeeze(np.diff(values, prepend=X.U(0)))


def spread_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(spread(blob), dtype=X.U)


def cut(keys: np.ndarray, bits: int) -> np.ndarray:
    """Bounds of the 2**bits hash ranges in sorted keys."""
    marks = np.arange(1, 1 << bits, dtype=X.U) << X.U(64 - bits) if bits else np.empty(0, X.U)
    return np.concatenate([[0], np.searchsorted(keys, marks), [len(keys)]])


def slice_bits(packs: DataFrame, keys_per_byte: float = 0.18, slice_keys: int = SLICE_KEYS) -> int:
    """Binary digits of the number of slices: bounded keys a slice, and as many as partitions."""
    total = packs.agg(F.sum("n_bytes")).first()[0] or 0
    parts = int(packs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, int(np.ceil(np.log2(max(total * keys_per_byte / slice_keys, parts, 1)))))


ASK = "slice int, pack long, keys binary, notes binary"
ANSWER = "pack long, slice int, answer binary"


def ask(packs: DataFrame, bits: int, keys_of: Callable) -> DataFrame:
    """Lists by slice.  ``keys_of(docs, held, texts)`` gives sorted distinct keys and a number each."""

    def run(batches):
        for batch in batches:
            for _, k, doc, held, texts in each_pack(batch):
                keys, notes = keys_of(doc, held, texts)
                at = cut(keys, bits)
                rows = [(s, k, squeeze_sorted(keys[a:b]), squeeze(notes[a:b])) for s, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if b > a]
                cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
                kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["slice", "pack", "keys", "notes"])

    return packs.select("pack", "doc", "held", "text").mapInArrow(run, ASK)


def answer(asked: DataFrame, reply: Callable) -> DataFrame:
    """One task a slice.  ``reply(keys, notes, owner, n)`` gets the joined lists of ``n`` packs
    (``owner`` numbers them) and gives a number for every entry, and one row of totals."""

    def run(group: pa.Table) -> pa.Table:
        s = group.column("slice")[0].as_py()
        packs = group.column("pack").to_pylist()
        keys = [spread_sorted(x) for x in group.column("keys").to_pylist()]
        notes = [spread(x) for x in group.column("notes").to_pylist()]
        sizes = [len(x) for x in keys]
        numbers, totals = reply(np.concatenate(keys), np.concatenate(notes))
        out = [squeeze(x) for x in np.split(numbers, np.cumsum(sizes)[:-1])]
        return pa.table(
            {"pack": pa.array([*packs, -1], pa.int64()), "slice": pa.array([s] * (len(packs) + 1), pa.int32()), "answer": pa.array([*out, squeeze(totals)], pa.binary())}
        )

    return asked.groupBy("slice").applyInArrow(run, ANSWER)


def answers_by_pack(answers: DataFrame, name: str = "answers") -> DataFrame:
    """(pack, answers): a list ordered by slice, in the order the keys were asked."""
    lists = F.transform(F.array_sort(F.collect_list(F.struct("slice", "answer"))), lambda x: x["answer"])
    return answers.where("pack >= 0").groupBy("pack").agg(lists.alias(name))


def answered(packs: DataFrame, answers: DataFrame) -> DataFrame:
    """Packs with their answers."""
    return packs.select("pack", "doc", "held", "text").join(answers_by_pack(answers), "pack", "left")


def answers_of(value) -> np.ndarray:
    """One array from a pack's list of answers."""
    blobs = value or []
    return np.concatenate([spread(b) for b in blobs]) if blobs else np.empty(0, X.U)
