"""Toxicity by nearest labelled examples: exact TF-IDF cosine over an inverted index.

Examples are labelled rows, at most ``MAX_EXAMPLES`` of them (those with the smallest hash of
their id).  Terms are all words of the examples; their inverse document frequencies count all
documents.  Words whose presence goes with the label among the examples (G-squared and a lift of
two either way) count fully, all others ``PLAIN`` times: the label weighs terms and deletes none.
The examples' vectors are what is broadcast, so the sample bounds it.

The index lists the examples of each term, those of frequent terms as full columns.  A query sums
its lists, and every example that can be among its k nearest is scored again from its own vector:
the result is exact.  The k nearest vote in proportion to their cosine, beside a prior; votes
become probabilities by a monotone fit on the examples themselves, each scored without itself.
The nearest examples and their cosines are returned as evidence.

Defined cases: a text without any word of an example (empty and null ones too) gets the share of toxic
examples without any term; labels without an id or a value teach nothing; repeated labels of an
id count once (the larger); rows with a null id have no remainder and are reported as held out;
repeated rows score alike; other columns are ignored; without examples every score is 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.durable import durable
from tidemark.llm import text as X
from tidemark.llm.tables import picked, remainder, table

MAX_EXAMPLES = 20_000
MIN_G2, MIN_LIFT, MIN_DOCS = 15.0, 2.0, 5
#: Weight of a word that does not go with the label.
PLAIN = 0.05
NEAREST, PRIOR_WEIGHT = 25, 1.0
EVIDENCE = 5
#: A term that one example in so many has is kept as a column; queries that are summed at once.
FREQUENT, TOGETHER = 16, 64
#: More than the rounding of the sums.
SLACK = 1e-4
#: Cells of the index that are counted or weighed at once.
CELLS = 1 << 20
#: Steps from the first key of a hash's leading bits before it is searched for.
STEPS = 8


def words_in(data: np.ndarray, off: np.ndarray) -> X.Words:
    return X.Words(X.LOWER[data], off, X.NOT_ALNUM)


def term_rows(batches):
    """Distinct words of each example with its label."""
    for batch in batches:
        y = np.asarray(batch.column("toxic"))
        for i, j, data, off in X.batches_of_text(batch):
            w = words_in(data, off)
            row, h = w.rows(), w.hashes()
            order = np.lexsort((h, row))
            new = np.ones(len(h), bool)
            new[1:] = (row[order][1:] != row[order][:-1]) | (h[order][1:] != h[order][:-1])
            pick = order[new]
            keys, place = np.unique(h[pick], return_inverse=True)
            label = y[i:j][row[pick]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), pa.array(np.bincount(place)), pa.array(np.bincount(place, label, len(keys)).astype(np.int64))],
                ["term", "n", "pos"],
            )


def choose_terms(examples: DataFrame, total: int, positive: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the examples, and which of them go with the label."""
    counts = examples.select("toxic", "text").mapInArrow(term_rows, "term long, n long, pos long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    if not total or not positive or positive == total:
        every = np.asarray(counts.select("term").toArrow().column("term").combine_chunks())
        return every, np.zeros(len(every), bool)

    def part(seen, margin):
        expected = F.col("n") * F.lit(margin / total)
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    def rest(seen, margin):
        expected = (F.lit(total) - F.col("n")) * F.lit(margin / total)
        left = F.lit(margin) - seen
        return F.when(left > 0, left * F.log(left / expected)).otherwise(0.0)

    neg = F.col("n") - F.col("pos")
    g2 = 2 * (part(F.col("pos"), positive) + part(neg, total - positive) + rest(F.col("pos"), positive) + rest(neg, total - positive))
    lift = (F.col("pos") / F.col("n")) / F.lit(positive / total)
    goes = (F.col("n") >= MIN_DOCS) & ((lift >= MIN_LIFT) | (lift <= 1 / MIN_LIFT)) & (g2 >= MIN_G2)
    out = counts.select("term", goes.alias("goes")).toArrow()  # bounded by the sample
    return np.asarray(out.column("term").combine_chunks()), out.column("goes").combine_chunks().to_numpy(zero_copy_only=False)


class Terms:
    def __init__(self, hashes):
        self.keys = np.sort(np.array(hashes, np.int64).view(X.U))
        self.first = None

    def __getstate__(self):
        return {"keys": self.keys, "first": None}

    def places(self, hashes) -> np.ndarray:
        return np.searchsorted(self.keys, np.array(hashes, np.int64).view(X.U))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first key not below each hash, and whether it is the hash."""
        n = len(self.keys)
        if self.first is None:
            bits = n.bit_length() + 1
            self.shift = X.U(64 - bits)
            self.first = np.zeros(1 << bits, np.int32)
            np.cumsum(np.bincount((self.keys >> self.shift).astype(np.int64), minlength=1 << bits)[:-1], out=self.first[1:])
            self.ended = np.append(self.keys, ~X.U(0))
        at = self.first[(h >> self.shift).astype(np.int64)]
        below = np.flatnonzero(self.ended[at] < h)
        for _ in range(STEPS):
            at[below] += 1
            below = below[self.ended[at[below]] < h[below]]
        at[below] = np.searchsorted(self.keys, h[below])
        return at, (at < n) & (self.ended[at] == h)

    def counts(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, count) of the terms in each row, by row."""
        w = words_in(data, off)
        n = len(self.keys)
        at, ok = self.find(w.hashes())
        pair, count = np.unique(w.rows()[ok] * max(n, 1) + at[ok], return_counts=True)
        return pair // max(n, 1), pair % max(n, 1), count


def document_counts(terms: Terms):
    def run(batches):
        total, docs = np.zeros(len(terms.keys) + 1, np.int64), 0
        for batch in batches:
            for i, j, data, off in X.batches_of_text(batch):
                _, t, _ = terms.counts(data, off)
                total[:-1] += np.bincount(t, minlength=len(terms.keys))
                docs += j - i
        total[-1] = docs
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    return run


class Index:
    """Inverted index of labelled TF-IDF vectors."""

    def __init__(self, terms: Terms, idf: np.ndarray, ids, labels, rows):
        """rows: (example, term, count) arrays; counts are kept, weights are made where the index is opened."""
        self.terms, self.idf = terms, idf
        ex, term, count = rows
        ids, labels = np.asarray(ids, np.int64), np.asarray(labels, np.int64)
        size = np.zeros(len(ids), np.int64)
        for a in range(0, len(ex), CELLS):
            size += np.bincount(ex[a : a + CELLS], minlength=len(ids))
        stand = np.flatnonzero(size)
        stand = stand[np.argsort(ids[stand], kind="stable")]
        place_of = np.full(len(ids), -1, np.int32)
        place_of[stand] = np.arange(len(stand))
        self.ids, self.labels = ids[stand], labels[stand]
        bare = labels[size == 0]
        self.prior = float(np.mean(labels)) if len(labels) else 0.0
        self.bare = float(bare.mean()) if len(bare) else self.prior
        place = place_of[ex]
        if not np.all((place[1:] > place[:-1]) | ((place[1:] == place[:-1]) & (term[1:] >= term[:-1]))):
            order = np.lexsort((term, place))
            term, count = term[order], count[order]
        self.edge = np.concatenate([[0], np.cumsum(size[stand])])
        self.term = term.astype(np.int32, copy=False)
        self.count = count.astype(np.min_scalar_type(count.max() if len(count) else 0))
        self.lists = None

    def __getstate__(self):
        made = ("weight", "begin", "column", "full", "query")
        return {k: v for k, v in self.__dict__.items() if k not in made} | {"lists": None}

    def open(self) -> Index:
        if self.lists is not None:
            return self
        self.weight = np.empty(len(self.term))
        for i, j in X.row_slices(self.edge, CELLS):
            part = slice(self.edge[i], self.edge[j])
            row = np.repeat(np.arange(j - i), np.diff(self.edge[i : j + 1]))
            self.weight[part] = self.weigh(row, self.term[part], self.count[part].astype(np.int64))
        order = np.argsort(self.term, kind="stable")
        has = np.bincount(self.term, minlength=len(self.idf))
        self.begin = np.concatenate([[0], np.cumsum(has)])
        example = np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.edge))[order].astype(np.intp)
        weight = self.weight.astype("<f4")[order]
        often = np.flatnonzero(has * FREQUENT > len(self.ids))
        self.column = np.full(len(self.idf), -1, np.int64)
        self.column[often] = np.arange(len(often))
        self.full = np.zeros((len(often), len(self.ids)), np.float32)
        for i, t in enumerate(often):
            part = slice(self.begin[t], self.begin[t + 1])
            self.full[i, example[part]] = weight[part]
        self.query = np.zeros(len(self.idf))
        # one number a cell: the example above 32 bits of weight
        example <<= 32
        example |= weight.view("<u4")
        self.lists = (example,)
        return self

    def weigh(self, row, term, count) -> np.ndarray:
        w = (1 + np.log(count)) * self.idf[term]
        norm = np.sqrt(np.bincount(row, w * w, row.max() + 1 if len(row) else 0))
        return w / norm[row]

    def frequent(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the frequent terms of each query (terms, weights) give every example."""
        self.open()
        q = np.zeros((len(queries), len(self.full)), np.float32)
        for i, (terms, weights) in enumerate(queries):
            c = self.column[terms]
            q[i, c[c >= 0]] = weights[c >= 0]
        return q @ self.full

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, but: int | None = None, begun: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples (cosine, then place); ``but`` is left out.
        ``begun`` is the query's row of ``frequent``."""
        begun = self.frequent([(terms, weights)])[0] if begun is None else begun
        few = self.column[terms] < 0
        start, stop = self.begin[terms[few]], self.begin[terms[few] + 1]
        total = begun.copy()
        if len(start):
            cell = np.concatenate([self.lists[0][a:b] for a, b in zip(start.tolist(), stop.tolist(), strict=True)])
            gain = np.repeat(weights[few].astype(np.float32), stop - start)
            gain *= cell.view("<f4")[::2]
            cell >>= 32
            total += np.bincount(cell, gain, len(total)).astype(np.float32)
        if but is not None:
            total[np.searchsorted(self.ids, but) : np.searchsorted(self.ids, but, "right")] = 0
        least = float(np.partition(total, len(total) - k)[len(total) - k]) - SLACK if len(total) > k else 0.0
        place = np.flatnonzero(total >= np.float32(least) if least > 0 else total > 0)
        if not len(place):
            return place, np.zeros(0)
        start, stop = self.edge[place], self.edge[place + 1]
        spans = [slice(a, b) for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
        first = np.cumsum(stop - start) - (stop - start)
        self.query[terms] = weights
        product = self.query.take(np.concatenate([self.term[x] for x in spans]))
        product *= np.concatenate([self.weight[x] for x in spans])
        score = np.round(np.add.reduceat(product, first), 12)
        self.query[terms] = 0
        best = np.lexsort((place, -score))[:k]
        best = best[score[best] > 0]
        return place[best], score[best]

    def vote(self, places: np.ndarray, cosines: np.ndarray) -> float:
        return float((cosines @ self.labels[places] + PRIOR_WEIGHT * self.prior) / (cosines.sum() + PRIOR_WEIGHT))

    def votes(self, data, off, ids=None):
        """(vote or nan, places, cosines) of each row; with ids, each row without itself."""
        row, term, count = self.terms.counts(data, off)
        weight = self.weigh(row, term, count)
        edge = np.searchsorted(row, np.arange(len(off)))
        known: dict = {}
        keys = []
        for i in range(len(off) - 1):
            a, b = edge[i], edge[i + 1]
            keys.append((term[a:b].tobytes(), count[a:b].tobytes(), None if ids is None else ids[i]) if b > a and len(self.ids) else None)
        first = {key: i for i, key in reversed(list(enumerate(keys))) if key is not None}
        todo = sorted(first.values())
        for a in range(0, len(todo), TOGETHER):
            queries = [(term[edge[i] : edge[i + 1]], weight[edge[i] : edge[i + 1]]) for i in todo[a : a + TOGETHER]]
            for i, query, begun in zip(todo[a : a + TOGETHER], queries, self.frequent(queries), strict=True):
                near = self.nearest(*query, NEAREST, keys[i][2], begun)
                known[keys[i]] = (self.vote(*near), *near)
        for key in keys:
            yield (np.nan, (), ()) if key is None else known[key]


def own_votes(examples: DataFrame, shared) -> DataFrame:
    """Vote (v) and label (y) of each example without itself, in no order: a sort would judge them all twice,
    once to find its ranges."""

    def run(batches):
        for batch in batches:
            ids, y = (np.asarray(batch.column(k)) for k in ("doc_id", "toxic"))
            for i, j, data, off in X.batches_of_text(batch):
                v = np.array([x[0] for x in shared.value.votes(data, off, ids[i:j])], float)
                yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(y[i:j].astype(np.int32))], ["v", "y"])

    return examples.mapInArrow(run, "v double, y int").where(~F.isnan("v"))


def monotone(votes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of a rising fit of label shares on votes (pooled neighbours, at least 20 each)."""
    order = np.lexsort((labels, votes))
    pools: list[list[float]] = []
    for part in np.array_split(order, max(1, len(order) // 20)):
        if not len(part):
            continue
        pools.append([votes[part].mean(), labels[part].mean(), len(part)])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
            b, a = pools.pop(), pools.pop()
            n = a[2] + b[2]
            pools.append([(a[0] * a[2] + b[0] * b[2]) / n, (a[1] * a[2] + b[1] * b[2]) / n, n])
    return np.array([p[0] for p in pools]), np.array([p[1] for p in pools])


def toxicity(docs: DataFrame, labels: DataFrame, held_out, max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """Score and evidence of every row of ``docs`` (doc_id, text); labelled rows for which
    ``held_out`` is true are no examples."""
    spark = docs.sparkSession
    base = picked(docs, doc_id="long", text="string")
    taught = (
        picked(labels, doc_id="long", toxic="int").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out)
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
    )
    # the broadcast side is at most max_examples rows of two numbers
    examples = durable(base.join(F.broadcast(taught), "doc_id").select("doc_id", "toxic", "text"), "examples")
    total, positive = examples.agg(F.count("*"), F.sum("toxic")).first()
    chosen, goes = choose_terms(examples, total, int(positive or 0))
    terms = Terms(chosen)
    counted = base.select("text").mapInArrow(document_counts(terms), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(len(terms.keys) + 1)
    seen[np.asarray(counted.column("at").combine_chunks())] = np.asarray(counted.column("n").combine_chunks())  # one row a term
    idf = np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1
    idf[terms.places(chosen)] *= np.where(goes, 1.0, PLAIN)

    def vectors(batches):
        for batch in batches:
            for i, j, data, off in X.batches_of_text(batch):
                row, t, c = terms.counts(data, off)
                cut = np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(cut, x.astype(np.int32)) for x in (t, c)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in ("doc_id", "toxic")), *lists], ["doc_id", "toxic", "t", "c"])

    known = examples.mapInArrow(vectors, "doc_id long, toxic int, t array<int>, c array<int>").orderBy("doc_id", "t", "c").toArrow()
    ids, toxic = (known.column(k).to_pylist() for k in ("doc_id", "toxic"))
    lists = [known.column(k).combine_chunks() for k in ("t", "c")]
    del known
    size = np.asarray(lists[0].value_lengths(), np.int64)
    flat = [np.asarray(x.flatten(), np.int32) for x in lists]
    owner = np.repeat(np.arange(len(size), dtype=np.int32), size)
    index = Index(terms, idf, ids, toxic, (owner, *flat))
    del lists, flat, owner
    shared = spark.sparkContext.broadcast(index)
    del index  # the driver keeps nothing of it

    own = own_votes(examples, shared).toArrow()  # bounded by the sample
    fit = monotone(np.asarray(own.column("v").combine_chunks()), np.asarray(own.column("y").combine_chunks(), float)) if own.num_rows else None

    def score(batches):
        for batch in batches:
            for i, j, data, off in X.batches_of_text(batch):
                near = list(shared.value.votes(data, off))
                v = np.array([x[0] for x in near], float)
                s = np.where(np.isnan(v), shared.value.bare, v)
                if fit is not None:
                    s = np.where(np.isnan(v), s, np.interp(v, *fit))
                ids = [shared.value.ids[np.asarray(x[1][:EVIDENCE], np.int64)].tolist() for x in near]
                cos = [[float(c) for c in x[2][:EVIDENCE]] for x in near]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, j - i),
                        pa.array(np.clip(s, 0.0, 1.0)),
                        pa.array((s >= 0.5).astype(np.int32)),
                        pa.array(ids, pa.list_(pa.int64())),
                        pa.array(cos, pa.list_(pa.float64())),
                    ],
                    ["doc_id", "score", "predicted", "evidence", "cosines"],
                )

    return base.mapInArrow(score, "doc_id long, score double, predicted int, evidence array<long>, cosines array<double>")


def op9_toxicity(spark, sf_dir):
    held = remainder("doc_id", 5) == 0
    out = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held)
    return out.select("doc_id", F.coalesce(held, F.lit(True)).alias("held_out"), "score", "predicted", "evidence")


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLES: dict[str, str] = {}
