"""Quality rules with suffix-array repetition.

For a batch of whole texts one suffix array over words is built by prefix doubling (only
suffixes that still share a prefix are sorted again), longest common prefixes of neighbours
come from the ranks kept at each doubling, and every neighbour pair with a long enough
prefix is an LCP interval: a maximal repeated substring.  The union of its spans gives the
covered words, the largest prefix the longest repeat.

Everything happens inside one row: no shuffle, no state between tasks, memory of one slice
of texts.  Defined cases: a null or empty text has no words and fails the base rule; repeated
rows are judged alike; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import text as X
from tidemark.llm.tables import picked

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

#: A repeat counts towards coverage from so many words on.
MIN_REPEAT = 8
#: Percent of the words that repeats may cover.
MAX_COVERED = 30
#: Words that the longest repeat may have.
MAX_LONGEST = 100
MIN_WORDS = 50
MAX_REPEATED_TRIGRAMS = 50

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, base_failed boolean, n_covered long, longest_repeat long, kept boolean"
)


def suffix_repeats(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours in the suffix array that share a prefix: (place, place, prefix length).

    ``ids`` are word ids, ``first`` the row bounds; a suffix ends with its row, and only
    suffixes of one row are neighbours."""
    n = len(ids)
    none = np.empty(0, np.int64)
    if n < 2:
        return none, none, none
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    stop = first[1:][rows]
    key = X.mix(ids.astype(X.U) + rows.astype(X.U) * X.U(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    rank = _group_starts(key[order], order)
    levels, width = [rank], 1
    active = _shared(rank)
    while len(active):
        ahead = active + width
        tail = np.where(ahead < stop[active], rank[np.minimum(ahead, n - 1)] + 1, 0)
        order = np.lexsort((tail, rank[active]))
        placed, head, tail = active[order], rank[active][order], tail[order]
        new = np.ones(len(placed), bool)
        new[1:] = (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])
        group = np.ones(len(placed), bool)
        group[1:] = head[1:] != head[:-1]
        at = np.arange(len(placed))
        rank = rank.copy()
        rank[placed] = head + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        levels.append(rank)
        width *= 2
        last = np.ones(len(placed), bool)
        last[:-1] = new[1:]
        active = placed[~(new & last)]
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    i, j = suffixes[:-1], suffixes[1:]
    same = levels[0][i] == levels[0][j]
    i, j = i[same], j[same]
    common = np.zeros(len(i), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        a, b = i + common, j + common
        ok = (a < stop[i]) & (b < stop[j])
        ok[ok] = levels[level][a[ok]] == levels[level][b[ok]]
        common[ok] += 1 << level
    return i, j, common


def _group_starts(sorted_key: np.ndarray, order: np.ndarray) -> np.ndarray:
    new = np.ones(len(order), bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return rank


def _shared(rank: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.bincount(rank, minlength=len(rank))[rank] > 1)


def union_size(i, j, common, least: int, width: int | None, first: np.ndarray) -> np.ndarray:
    """Words of each row inside a repeat of ``least`` words or more."""
    use = common >= least
    at = np.concatenate([i[use], j[use]])
    length = np.concatenate([common[use]] * 2) if width is None else np.full(len(at), width)
    n = int(first[-1])
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + length, -1)
    return X.row_sums((np.cumsum(step[:n]) > 0).astype(np.int64), first)


def line_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, position in its row) of every line; an empty row has one."""
    breaks = np.flatnonzero(data == 10)
    row = np.concatenate([np.arange(len(off) - 1), np.searchsorted(off, breaks, "right") - 1])
    start = np.concatenate([off[:-1], breaks + 1])
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    end = off[1:][row]
    inner = row[1:] == row[:-1]
    end[:-1][inner] = start[1:][inner] - 1
    first = np.searchsorted(row, np.arange(len(off) - 1))
    return row, start, end, np.arange(len(row)) - first[row]


def duplicate_lines(words: X.Words) -> np.ndarray:
    """Lines of each row with a word that equal an earlier line of the row."""
    row, start, end, _ = line_spans(words.data, words.offsets)
    some = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    row, h = row[some], X.span_hash(words.data, start[some], end[some], seed=21)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    again = (row[1:] == row[:-1]) & (h[1:] == h[:-1])
    return np.bincount(row[1:][again], minlength=len(words.offsets) - 1)


def measures(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    words = X.Words(data, off)
    i, j, common = suffix_repeats(words.hashes(), words.first)
    longest = np.zeros(len(off) - 1, np.int64)
    np.maximum.at(longest, words.rows()[i], common)
    letters = (~X.SPACE[data]) & ((data & 0xC0) != 0x80)
    return {
        "n_words": words.counts,
        "word_chars": X.row_sums(letters.astype(np.int64), off),
        "n_symbols": X.row_sums(SYMBOLS[data].astype(np.int64), off),
        "n_dup_lines": duplicate_lines(words),
        "n_repeat_words": union_size(i, j, common, 3, None, words.first),
        "n_covered": union_size(i, j, common, MIN_REPEAT, None, words.first),
        "longest_repeat": longest,
    }


def verdict(m: dict[str, np.ndarray], max_covered: int, max_longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(base failed, kept) for each row."""
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEATED_TRIGRAMS * m["n_words"])
    return failed, ~failed & (100 * m["n_covered"] <= max_covered * m["n_words"]) & (m["longest_repeat"] <= max_longest)


def quality(docs: DataFrame, max_covered: int = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """Measures and verdict of every document (doc_id, text)."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def judge(batches):
        for batch in batches:
            for a, b, data, off in X.batches_of_text(batch):
                m = measures(data, off)
                failed, good = verdict(m, max_covered, max_longest)
                out = {"doc_id": batch.column("doc_id").slice(a, b - a), **m, "base_failed": failed, "kept": good}
                yield pa.RecordBatch.from_arrays([out[n] if n == "doc_id" else pa.array(out[n]) for n in names], names)

    return picked(docs, doc_id="long", text="string").mapInArrow(judge, SCHEMA)


def passing(docs: DataFrame, max_covered: int = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns."""

    def sift(batches):
        for batch in batches:
            good = [np.empty(0, bool)]
            for _, _, data, off in X.batches_of_text(batch):
                good.append(verdict(measures(data, off), max_covered, max_longest)[1])
            yield batch.filter(pa.array(np.concatenate(good)))

    return docs.mapInArrow(sift, docs.schema)


def op7_quality_rules(spark, sf_dir):
    from tidemark.llm.tables import table

    return quality(table(spark, sf_dir, "documents")).drop("longest_repeat")


QUERIES = {"op7_quality_rules": op7_quality_rules}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
ORACLES = {
    "op7_quality_rules": rf"""
with d as (select doc_id, coalesce(text, '') as t, {_WORDS} as w from documents),
g as (select row_number() over () as rid, * from d),
p as (select rid, i, n from g, unnest([3, {MIN_REPEAT}, {MAX_LONGEST + 1}]) as k(n), unnest(range(1, len(w) - n + 2)) as x(i)),
h as (select p.rid, p.i, p.n, hash(list_slice(g.w, p.i, p.i + p.n - 1)) as h from p join g using (rid)),
c as (select rid, i, n, count(*) over (partition by rid, n, h) as k from h),
r as (select rid, n, i from c where k > 1),
cov as (select rid, n, count(distinct j) as words from r, unnest(range(i, i + n)) as y(j)
  where n <= {MIN_REPEAT} group by rid, n),
lines as (select rid, x as line, count(*) as k from (select rid, unnest(string_split(t, chr(10))) as x from g)
  where regexp_matches(x, '[^\x20\x09-\x0D]') group by rid, x),
dup as (select rid, sum(k - 1) as n_dup from lines group by rid),
b as (
select g.rid, doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
  coalesce(n_dup, 0) as n_dup_lines, coalesce(c3.words, 0) as n_repeat_words, coalesce(c8.words, 0) as n_covered,
  exists (select 1 from r where r.rid = g.rid and r.n = {MAX_LONGEST + 1}) as too_long
from g left join dup using (rid)
left join cov c3 on c3.rid = g.rid and c3.n = 3
left join cov c8 on c8.rid = g.rid and c8.n = {MIN_REPEAT})
select cast(doc_id as bigint) as doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars,
  cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
  cast(n_repeat_words as bigint) as n_repeat_words,
  (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEATED_TRIGRAMS} * n_words) as base_failed,
  cast(n_covered as bigint) as n_covered,
  (n_words >= {MIN_WORDS} and 100 * n_repeat_words <= {MAX_REPEATED_TRIGRAMS} * n_words
    and 100 * n_covered <= {MAX_COVERED} * n_words and not too_long) as kept
from b""",
}
