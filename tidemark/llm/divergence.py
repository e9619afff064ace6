"""Source divergence audit: how far each source's terms are from its language's and from other sources'.

A language keeps the terms of at least ``MIN_DOCS`` of its documents; with counts c over N
kept occurrences of V terms, p = 1 + floor(SCALE * (c + 1) / (N + V)), in a group (language,
source) or in the whole language, and the divergence of p from q is floor((p - q)^2 / q).

Terms, by *count-cell ranking*: a term's value depends only on the cell (count in the group,
count in the language).  So terms are grouped by cell, the value is computed once a cell, and
cells of equal value merge.  Values are ranked by cumulative multiplicity, which tells at which
rank each begins; only the cells that begin within ``RANKS`` are expanded into terms, in UTF-8
order, and of those only the first ``RANKS``.  Most terms are rare and share few cells.

Pairs of sources: every task holds a range of a language's terms, as slices of a matrix (terms
x sources) of p, and adds up one row and column of pairs at a time; a group's p for absent
terms fills the matrix first.  What leaves a task is one sum for each pair of sources, which is
the result's own size, never a row for each pair of a term's sources.

Texts are split where they are read.  Terms are numbered by a dictionary, exactly, counted by
document (for ``MIN_DOCS``) and by group, and shuffled as sums.

Defined cases: null text, language and source count as ''; rows are documents, also where ids
repeat or are null; a group without terms has all kept terms with count 0; a language without
kept terms has pairs of value 0 and no terms; other columns are ignored; an empty table has no
rows.  Sums of values fit in a long while a language has less than 2 * 10^9 kept terms.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.durable import durable
from tidemark.llm import text as X
from tidemark.llm.tables import picked, table

MIN_DOCS = 3
SCALE = 1_000_000_000
#: The last rank of a group's terms.
RANKS = 200
#: Text that is counted at once, unless one text is longer.
SLICE_BYTES = 8 << 20
#: Parts in which the terms of a cell are met.
SALTS = 16
#: Entries of a matrix (terms x sources).
CELLS = 1 << 20

#: What separates terms, after lower-casing.
BETWEEN = np.ones(256, bool)
BETWEEN[97:123] = BETWEEN[128:] = False

COUNTS = "lang string, source string, term string, n long, docs long"


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct terms, number of each occurrence's term, its row) of a slice of texts."""
    data = X.LOWER[data]
    w = X.Words(data, offsets, BETWEEN)
    # nothing but terms is left, so that they are a string array without copying one by one
    inside = data[~BETWEEN[data]]
    ends = np.concatenate([[0], np.cumsum(w.end - w.start)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(w), pa.py_buffer(ends), pa.py_buffer(inside)).dictionary_encode()
    return words.dictionary, np.asarray(words.indices, np.int64), w.rows()


def distinct(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct rows of the columns in order, then for each the places where it begins in the
    sorted order, and that order."""
    order = np.lexsort(columns[::-1])
    rows = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.any([r[1:] != r[:-1] for r in rows], axis=0)
    at = np.flatnonzero(new)
    return *(r[at] for r in rows), at, order


def count_terms(batches):
    """Map side: for each (language, source, term) of a slice its occurrences and documents."""
    for batch in batches:
        lang, source = (batch.column(c).to_pylist() for c in ("lang", "source"))
        for i, j, data, off in X.batches_of_text(batch, "text", SLICE_BYTES):
            names = sorted(set(zip(lang[i:j], source[i:j], strict=True)))
            number = {x: k for k, x in enumerate(names)}
            group = np.asarray([number[x] for x in zip(lang[i:j], source[i:j], strict=True)], np.int64)
            words, code, row = terms_of(data, off)
            pair = row * max(len(words), 1) + code
            pair.sort()
            first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.empty(0, np.int64)
            n = np.diff(np.append(first, len(pair)))
            row, code = pair[first] // max(len(words), 1), pair[first] % max(len(words), 1)
            g, code, at, order = distinct(group[row], code)
            sums = [np.add.reduceat(x[order], at) if len(at) else x for x in (n, np.ones_like(n))]
            kinds = [pa.array([x[k] for x in names], pa.string()).take(pa.array(g)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [*kinds, words.take(pa.array(code)), *(pa.array(x, pa.int64()) for x in sums)], [f.split(" ")[0] for f in COUNTS.split(", ")]
            )


def p_of(count: str, total: str, kinds: str) -> Column:
    """p as a long; decimals hold the product whatever the count."""
    return F.expr(f"1 + cast({SCALE} as decimal(10,0)) * cast({count} + 1 as decimal(19,0)) div cast({total} + {kinds} as decimal(19,0))")


def f_of(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div {q}")


class Audit:
    """Tables of one audit, each written once: ``counts`` of kept terms by group, with the
    language's; ``groups`` with their totals."""

    def __init__(self, docs: DataFrame):
        docs = picked(docs, lang="string", source="string", text="string")
        docs = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in docs.columns])
        counts = durable(
            docs.mapInArrow(count_terms, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts"
        )
        kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
        kept = kept.where(F.col("docs") >= MIN_DOCS).select("lang", "term", "lang_n")
        self.counts = durable(counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "kept-counts")
        totals = self.counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        langs = self.counts.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("kinds"))
        lang_totals = totals.groupBy("lang").agg(F.sum("total").alias("lang_total"))
        groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left")
        groups = groups.join(langs, "lang", "left").join(lang_totals, "lang", "left")
        self.groups = durable(groups.na.fill(0, ["total", "kinds", "lang_total"]), "groups")

    def terms(self) -> DataFrame:
        """(lang, source, item, value, rank) of the terms that a group has more of than its language."""
        cells = self.counts.groupBy("lang", "source", "n", "lang_n").agg(F.count("*").alias("many"))
        cells = cells.join(self.groups, ["lang", "source"])
        cells = cells.withColumn("p", p_of("n", "total", "kinds")).withColumn("q", p_of("lang_n", "lang_total", "kinds"))
        cells = durable(cells.where("p > q").select("lang", "source", "n", "lang_n", "many", f_of("p", "q").alias("value")), "cells")
        # a value has a term at least, so what begins within RANKS is among the first RANKS values
        by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
        values = cells.groupBy("lang", "source", "value").agg(F.sum("many").alias("many"))
        values = values.withColumn("k", F.row_number().over(by_value)).where(F.col("k") <= RANKS)
        values = values.withColumn("before", F.sum("many").over(by_value.rowsBetween(Window.unboundedPreceding, -1)))
        values = values.select("lang", "source", "value", F.coalesce("before", F.lit(0)).alias("before")).where(F.col("before") < RANKS)
        chosen = cells.join(values, ["lang", "source", "value"]).select("lang", "source", "n", "lang_n", "value", "before")
        # rare terms share few cells: each is met in parts, by a hash of the term
        salt = F.pmod(F.xxhash64("term"), F.lit(SALTS)).alias("salt")
        chosen = chosen.withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
        found = self.counts.select("*", salt).join(chosen, ["lang", "source", "n", "lang_n", "salt"])
        # the first of a value's terms are taken in each partition before they meet
        among = F.row_number().over(Window.partitionBy("lang", "source", "value").orderBy("term"))
        found = found.withColumn("among", among).where(F.col("among") <= RANKS)
        found = found.select("lang", "source", F.col("term").alias("item"), "value", (F.col("before") + F.col("among")).cast("int").alias("rank"))
        return found.where(F.col("rank") <= RANKS)

    def pairs(self) -> DataFrame:
        """(lang, source, item, value, rank): each other source of the language."""
        n = int(self.groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        bucket = F.pmod(F.xxhash64("term"), F.lit(n)).cast("int")
        held = self.groups.withColumn("p0", F.when(F.col("kinds") > 0, p_of("0L", "total", "kinds")).otherwise(1))
        entries = self.counts.join(self.groups, ["lang", "source"]).select("lang", bucket.alias("bucket"), "term", "source", p_of("n", "total", "kinds").alias("p"))
        # each range of terms starts with the language's sources; a null term comes first
        heads = held.select("lang", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bucket"), F.lit(None).cast("string").alias("term"), "source", F.col("p0").alias("p"))
        order = ("lang", "bucket", "term", "source")
        rows = entries.union(heads).repartition(n, "lang", "bucket").sortWithinPartitions(*order)
        sums = rows.mapInArrow(add_pairs, "lang string, source string, item string, value long")
        totals = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return totals.withColumn("rank", F.row_number().over(order))

    def result(self) -> DataFrame:
        parts = [df.select("lang", "source", F.lit(name).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank")) for name, df in (("pair", self.pairs()), ("term", self.terms()))]
        return parts[0].union(parts[1])


class PairSums:
    """Sums over terms of the divergence of each source's p from each other's."""

    def __init__(self, lang: str):
        self.lang, self.names, self.p0 = lang, [], []
        self.sums = None
        self.rows, self.columns, self.values, self.open, self.term = [], [], [], 0, None

    def head(self, source: str, p0: int) -> None:
        if self.sums is None:  # every range of a language names the same sources
            self.names.append(source)
            self.p0.append(p0)

    def ready(self) -> None:
        if self.sums is not None:
            return
        n = len(self.names)
        self.number = {x: i for i, x in enumerate(self.names)}
        self.zero = np.asarray(self.p0, np.int64)
        self.sums = np.zeros((n, n), np.int64)
        self.most = max(1, CELLS // max(n, 1))

    def add(self, term: str, source: str, p: int) -> None:
        self.ready()
        if term != self.term:
            if self.open == self.most:
                self.flush()
            self.term, self.open = term, self.open + 1
        self.rows.append(self.open - 1)
        self.columns.append(self.number[source])
        self.values.append(p)

    def flush(self) -> None:
        p = np.repeat(self.zero[:, None], self.open, axis=1)
        p[self.columns, self.rows] = self.values
        for i in range(len(p)):
            d = p[i] - p
            self.sums[i] += (d * d // p).sum(axis=1)
        self.rows, self.columns, self.values, self.open = [], [], [], 0

    def result(self) -> pa.RecordBatch:
        self.ready()
        if self.open:
            self.flush()
        n = len(self.names)
        i, j = np.nonzero(~np.eye(n, dtype=bool))
        names = pa.array(self.names, pa.string())
        columns = [pa.array([self.lang] * len(i), pa.string()), names.take(pa.array(i)), names.take(pa.array(j)), pa.array(self.sums[i, j], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["lang", "source", "item", "value"])


def add_pairs(batches):
    """Streams a sorted partition: the ranges of terms of one language after the other's."""
    held = bucket_of = None
    for batch in batches:
        for lang, bucket, term, source, p in zip(*(batch.column(c).to_pylist() for c in ("lang", "bucket", "term", "source", "p")), strict=True):
            if held is None or lang != held.lang:
                if held is not None:
                    yield held.result()
                held, bucket_of = PairSums(lang), bucket
            if bucket != bucket_of:
                held.ready()
                bucket_of = bucket
            if term is None:
                held.head(source, p)
            else:
                held.add(term, source, p)
    if held is not None:
        yield held.result()


def audit(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): other sources (``pair``) and outstanding terms (``term``)."""
    return Audit(docs).result()


def op12_divergence(spark, sf_dir):
    return audit(table(spark, sf_dir, "documents"))


QUERIES = {"op12_divergence": op12_divergence}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_P = f"1 + ({SCALE}::hugeint * ({{c}} + 1)) // ({{n}} + v)"

ORACLES = {
    "op12_divergence": rf"""
with d as (select row_number() over () as rid, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as text from documents),
w as (select rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term, count(*) as lc from w group by all having count(distinct rid) >= {MIN_DOCS}),
c as (select lang, source, term, count(*) as c from w join kept using (lang, term) group by all),
g as (select lang, source, coalesce(n, 0) as n, coalesce(v, 0) as v, coalesce(ln, 0) as ln
  from (select distinct lang, source from d)
  left join (select lang, source, sum(c) as n from c group by all) using (lang, source)
  left join (select lang, count(*) as v, sum(lc) as ln from kept group by all) using (lang)),
m as (select g.lang, g.source, k.term, coalesce(c.c, 0) as c, {_P.format(c='coalesce(c.c, 0)', n='g.n')} as p,
    {_P.format(c='k.lc', n='g.ln')} as q
  from g join kept k using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
pv as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
  from m a join m b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(pv.value, 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join pv on pv.lang = a.lang and pv.source = a.source and pv.item = b.source),
terms as (select lang, source, 'term' as part, term as item, ((p - q) * (p - q) // q)::bigint as value
  from m where c > 0 and p > q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank
  from (from pairs union all from terms))
select lang, source, part, item, value, rank from r where part = 'pair' or rank <= {RANKS}""",
}
