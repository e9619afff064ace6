"""Language identification by rank-order profiles of n-grams.

A profile is the ``TOP`` most frequent n-grams (1 to 3 letters, words padded on both sides) in
order; ties go by code points.  Each language's profile is counted over all its training
documents; a document has one of its own.  The out-of-place distance between the two is the
sum, over the document's n-grams, of how many ranks each is off, or ``TOP`` where the language
has it nowhere.  The nearest language is predicted, the first by name if several are.

An n-gram is one 64-bit number (three code points of 21 bits), exactly.  Training counts are
summed per batch before they are shuffled, and only the best ranks of each partition take part
in the ranking of a language.  Documents meet the profiles where they are read: profiles are
``TOP`` numbers a language, sent in blocks of ``BLOCK`` languages, one pass over the texts each,
so what is broadcast is bounded however many language names there are.

The score is the share of agreement: with agreement 1 - distance / (TOP * n-grams) of each
language, that of the nearest over the sum of the two nearest (1 if no other is learned or
agrees).  So it is 0.5 for a toss-up and higher the farther the second is.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is every text
when nothing was learned; null languages and the held-out documents teach nothing, an empty
language name is a name; documents of null id are neither held out nor learned from; repeated
rows count as often as they occur; other columns are ignored; an empty table has no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.durable import durable
from tidemark.llm.tables import picked, remainder, table

#: Length of a profile.
TOP = 300
LETTERS = 3
#: Documents with this remainder of crc32 are held out.
FOLDS = 5
#: Languages whose profiles one pass holds.
BLOCK = 512
#: Characters that are counted at once, unless one text is longer.
CHARS = 1 << 20
NONE = "und"
BITS, PAD = np.uint64(21), 1
U = np.uint64


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grouped(texts: list[str | None], limit: int = CHARS):
    """(from, to) of runs of texts of about ``limit`` characters."""
    at = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= limit:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def counted(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, n-gram, count), by owner and n-gram, for the n-grams of each text."""
    low = [(t or "").lower() for t in texts]
    points = np.frombuffer(("\0" + "\0".join(low) + "\0").encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(low)), [len(t) + 1 + (i == 0) for i, t in enumerate(low)])
    letter = letters()[points]
    # what is between words, and at both ends, is one pad
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    points, owner, letter = points[keep], owner[keep], letter[keep]
    # letters as dense numbers in the order of their code points, so that (owner, n-gram) is one number
    seen = np.zeros(0x110000, bool)
    seen[points[letter]] = True
    alphabet = np.flatnonzero(seen).astype(U)
    bits = U(int(len(alphabet) + 1).bit_length())
    if int(len(low)).bit_length() + LETTERS * int(bits) > 64:
        half = len(low) // 2
        first, then = counted(low[:half]), counted(low[half:])
        return np.concatenate([first[0], then[0] + half]), *(np.concatenate(x) for x in zip(first[1:], then[1:], strict=True))
    number = np.full(0x110000, PAD, U)
    number[alphabet.astype(np.int64)] = np.arange(len(alphabet), dtype=U) + U(PAD + 1)
    a = np.where(letter, number[points], U(PAD))
    # an n-gram belongs to the owner of its first letter
    owner = np.where(letter, owner, np.append(owner[1:], 0)).astype(U) << U(LETTERS * int(bits))
    pairs, key = [(owner | a)[letter]], a
    for n in range(2, LETTERS + 1):
        key = (key[:-1] << bits) | a[n - 1 :]
        inside = np.ones(len(key), bool)
        for j in range(1, n - 1):
            inside &= letter[j : j + len(key)]
        pairs.append((owner[: len(key)] | key)[inside])
    pair = np.concatenate(pairs)
    pair.sort()
    new = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.empty(0, np.int64)
    pair, count = pair[new], np.diff(np.append(new, len(pair)))
    points_of = np.concatenate([[U(0), U(PAD)], alphabet])
    keys = np.zeros(len(pair), U)
    for j in reversed(range(LETTERS)):
        keys = (keys << BITS) | points_of[((pair >> U(j * int(bits))) & ((U(1) << bits) - U(1))).astype(np.int64)]
    return (pair >> U(LETTERS * int(bits))).astype(np.int64), keys, count


def ranked(owner: np.ndarray, keys: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, n-gram, rank) of each owner's first ``TOP`` n-grams by count, then code points.

    Takes what ``counted`` gives: (owner, count from above, place) is one sortable number."""
    if not len(owner):
        return owner, keys, count
    first = np.searchsorted(owner, np.arange(owner[-1] + 1))
    place = np.arange(len(owner)) - first[owner]
    most = int(count.max())
    low, mid = U(int(place.max()).bit_length()), U(most.bit_length())
    packed = (owner.astype(U) << (low + mid)) | ((most - count).astype(U) << low) | place.astype(U)
    if int(owner[-1]).bit_length() + int(low + mid) > 64:
        order = np.lexsort((place, -count, owner))
    else:
        packed.sort()
        order = first[owner] + (packed & ((U(1) << low) - U(1))).astype(np.int64)
    few = place < TOP
    return owner[few], keys[order[few]], place[few]


def count_languages(batches):
    """Map side: sums of a batch's n-grams by language."""
    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
        names = sorted(set(langs))
        number = {x: i for i, x in enumerate(names)}
        parts = []
        for i, j in grouped(texts):
            owner, keys, count = counted(texts[i:j])
            lang = np.asarray([number[x] for x in langs[i:j]], np.int64)[owner]
            parts.append(_summed(lang, keys, count))
        lang, keys, count = _summed(*(np.concatenate(x) for x in zip(*parts, strict=True))) if parts else (np.empty(0, np.int64),) * 3
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()).take(pa.array(lang, pa.int64())), pa.array(keys.view(np.int64)), pa.array(count, pa.int64())],
            ["lang", "gram", "n"],
        )


def _summed(lang, keys, count):
    order = np.lexsort((keys, lang))
    lang, keys, count = lang[order], keys[order], count[order]
    new = np.ones(len(keys), bool)
    new[1:] = (lang[1:] != lang[:-1]) | (keys[1:] != keys[:-1])
    at = np.flatnonzero(new)
    return lang[at], keys[at], np.add.reduceat(count, at) if len(at) else count


def learn(docs: DataFrame) -> DataFrame:
    """(lang, gram, rank) from (lang, text): the profile of each language."""
    counts = docs.where("lang is not null").select("lang", "text").mapInArrow(count_languages, "lang string, gram long, n long")
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    totals = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # a rank that is bounded is taken in each partition before rows of a language meet
    return totals.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < TOP).select("lang", "gram", "rank")


class Profiles:
    """Ranks of a block of languages by n-gram: ``rank[i, k]`` of gram i in language k, or -1."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.names = sorted({r[0] for r in rows}, key=str.encode)
        number = {x: i for i, x in enumerate(self.names)}
        self.grams = np.unique(np.asarray([r[1] for r in rows], np.int64).view(U))
        self.rank = np.full((len(self.grams) + 1, len(self.names)), -1, np.int32)
        for name, gram, rank in rows:
            self.rank[np.searchsorted(self.grams, U(gram)), number[name]] = rank

    def distances(self, owner: np.ndarray, keys: np.ndarray, rank: np.ndarray, n: int) -> np.ndarray:
        """Out-of-place distance of each of ``n`` documents to each language."""
        at = np.searchsorted(self.grams, keys)
        known = at < len(self.grams)
        known[known] = self.grams[at[known]] == keys[known]
        at = np.where(known, at, len(self.grams))
        out = np.zeros((n, len(self.names)), np.int64)
        for k in range(len(self.names)):
            there = self.rank[at, k]
            out[:, k] = np.bincount(owner, np.where(there < 0, TOP, np.abs(there - rank)), minlength=n).astype(np.int64)
        return out


BEST = "doc_id long, held_out boolean, text string, n_grams int, near string, d1 long, d2 long"


def nearest(profiles: Profiles):
    """A pass over the documents: the nearest language so far, its distance and the second's."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            near, d1, d2 = (batch.column(c).to_pylist() for c in ("near", "d1", "d2"))
            sizes = np.zeros(len(texts), np.int32)
            for i, j in grouped(texts):
                owner, keys, rank = ranked(*counted(texts[i:j]))
                sizes[i:j] = np.bincount(owner, minlength=j - i)
                d = profiles.distances(owner, keys, rank, j - i)
                first = d.argmin(1)
                best = d[np.arange(j - i), first]
                d[np.arange(j - i), first] = np.iinfo(np.int64).max
                second = d.min(1)
                for r in range(i, j):
                    a, b = int(best[r - i]), int(second[r - i])
                    held = [x for x in ((d1[r], near[r]), (d2[r], None), (a, profiles.names[first[r - i]]), (b, None)) if x[0] is not None and x[0] < np.iinfo(np.int64).max]
                    held.sort(key=lambda x: (x[0], x[1] is None))
                    (d1[r], near[r]), d2[r] = held[0], held[1][0] if len(held) > 1 else None
            kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64())
            new = [pa.array(x, k) for x, k in zip((sizes, near, d1, d2), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), batch.column("text"), *new], [f.split(" ")[0] for f in BEST.split(", ")])

    return run


def identify(docs: DataFrame, profiles: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) from (doc_id, held_out, text)."""
    profiles = durable(profiles, "profiles")
    spark = docs.sparkSession
    out = docs.select("doc_id", "held_out", "text", F.lit(0).alias("n_grams"), F.lit(None).cast("string").alias("near"), *[F.lit(None).cast("long").alias(c) for c in ("d1", "d2")])
    last = None
    while True:  # one pass a block of names, in order; the driver holds one block at a time
        names = profiles.select("lang").distinct()
        names = [r.lang for r in (names if last is None else names.where(F.col("lang") > last)).orderBy("lang").limit(BLOCK).collect()]
        if not names:
            break
        chosen = profiles.where((F.col("lang") >= names[0]) & (F.col("lang") <= names[-1]))
        block = spark.sparkContext.broadcast(Profiles([(r.lang, r.gram, r["rank"]) for r in chosen.collect()]))
        out = out.mapInArrow(_with(block), BEST)
        last = names[-1]
    agree = [1 - F.col(d) / (F.col("n_grams") * TOP) for d in ("d1", "d2")]
    both = agree[0] + F.coalesce(agree[1], F.lit(0.0))
    score = F.when(both > 0, agree[0] / both).otherwise(F.lit(0.5))
    found = (F.col("n_grams") > 0) & F.col("near").isNotNull()
    return out.select(
        "doc_id", "held_out",
        F.when(found, F.col("near")).otherwise(NONE).alias("lang_pred"),
        F.when(found, score).otherwise(0.0).alias("score"),
    )


def _with(block):
    return lambda batches: nearest(block.value)(batches)


def languages(docs: DataFrame) -> DataFrame:
    """Every document with the language predicted from its text, learned on all but the held-out fold."""
    docs = picked(docs, doc_id="long", text="string", lang="string")
    fold = remainder("doc_id", FOLDS)
    profiles = learn(docs.where(fold != 0))
    return identify(docs.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "text"), profiles)


def op11_language_id(spark, sf_dir):
    return languages(table(spark, sf_dir, "documents"))


QUERIES = {"op11_language_id": op11_language_id}

#: crc32 and n-grams of letters in any script have no counterpart in SQL; tests hold it against brute force.
ORACLES = {}
