"""Whole-batch text kernels: words, hashes of words and of word windows, as numpy arrays.

Arrow hands a task its strings as one byte buffer with offsets.  The kernels work on that
buffer directly, a slice of rows at a time, so memory is bounded by one slice (or one text)
and no word becomes a Python object unless an operator needs it.  Null texts have no bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: Bytes of text that one slice holds, unless a single text is longer.
SLICE_BYTES = 1 << 20
U = np.uint64

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: What separates the words of benchmark matching, after lower-casing.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[48:58] = NOT_ALNUM[97:123] = NOT_ALNUM[128:] = False


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; row i is bytes[offsets[i]:offsets[i+1]]."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def row_slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = to


class Words:
    """Words of a slice: byte spans ``start``/``end``; row i has words first[i]:first[i+1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE):
        self.data, self.offsets = data, offsets
        inside = ~separator[data]
        n = len(data)
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        before[offsets[:-1][offsets[:-1] < n]] = False
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """Row of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def hashes(self, seed: int = 1, table: np.ndarray | None = None) -> np.ndarray:
        return span_hash(self.data, self.start, self.end, seed, table)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, row) of every window of ``width`` words inside one row."""
        rows = self.rows()
        at = np.arange(len(self))
        ok = at + width <= self.first[rows + 1]
        return at[ok], rows[ok]


def batches_of_text(batch: pa.RecordBatch, name: str = "text", limit: int = SLICE_BYTES):
    """(rows from, rows to, bytes, offsets) for each slice of a batch."""
    data, off = text_buffer(batch.column(name))
    for i, j in row_slices(off, limit):
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


@lru_cache(maxsize=8)
def _base(seed: int) -> int:
    return int(np.random.default_rng(seed).integers(1 << 62)) * 8 + 5


def _powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the seed's odd base and of its inverse, modulo 2^64."""
    if seed not in _POWERS or len(_POWERS[seed][0]) < n:
        base = _base(seed) % (1 << 64)
        size = max(n, SLICE_BYTES // 4)
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, U)
            p[0] = 1
            pair.append(np.cumprod(p))
        _POWERS[seed] = (pair[0], pair[1])
    return _POWERS[seed]


def _spans(values: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """Polynomial hashes of short spans of values that are hashes themselves.

    Only for spans of fewer than a thousand values: longer ones can be built so that they
    collide under every odd base."""
    up, down = _powers(seed, len(values) + 1)
    prefix = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], out=prefix[1:])
    h = (prefix[end] - prefix[start]) * down[start]
    return mix(h + (end - start).astype(U) * U(0x9E3779B97F4A7C15))


#: Longest span, in bytes, that is hashed eight bytes a step over all spans at once.
STEPPED = 64


def span_hash(data, start, end, seed: int = 1, table: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of byte spans; ``table`` maps bytes first (lower-casing, say).

    Each step mixes the next eight bytes into the state of every span that has them, so equal
    hashes need equal states by chance; longer spans take a keyed library hash each."""
    if table is not None:
        data = table[data]
    n = (end - start).astype(np.int64)
    h = mix(n.astype(U) * U(0x9E3779B97F4A7C15) + U(_base(seed) % (1 << 64)))
    short = np.flatnonzero((n > 0) & (n <= STEPPED))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    at, left = start[short].astype(np.int64), n[short]
    while len(short):
        lane = eight[at]
        tail = left < 8
        lane[tail] &= (U(1) << (left[tail].astype(U) * U(8))) - U(1)
        h[short] = mix(h[short] ^ lane)
        more = left > 8
        short, at, left = short[more], at[more] + 8, left[more] - 8
    long = np.flatnonzero(n > STEPPED)
    if len(long):
        raw, key = memoryview(np.ascontiguousarray(data)), seed.to_bytes(8, "little")
        digests = [blake2b(raw[i:j], digest_size=8, key=key).digest() for i, j in zip(start[long].tolist(), end[long].tolist(), strict=True)]
        h[long] = np.frombuffer(b"".join(digests), "<u8")
    return h


def window_hash(values: np.ndarray, at: np.ndarray, width: int, seed: int = 2) -> np.ndarray:
    """64-bit hashes of the ``width`` values from each position in ``at``."""
    if not len(at):
        return np.empty(0, U)
    return _spans(values, at, at + width, seed)


def covered(at: np.ndarray, width: int, n: int) -> np.ndarray:
    """True for each of ``n`` places inside one of the windows [at, at + width)."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + width, -1)
    return np.cumsum(step[:n]) > 0


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[i]:first[i+1]] for each row."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
