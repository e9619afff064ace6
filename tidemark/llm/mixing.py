"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations.

A document of source s should be taken target(s) / size(s) times.  The whole part is certain;
the fraction is rounded by pivotal steps: two documents with fractional probabilities meet,
and mass moves from one to the other, at random and in proportion to their sizes, until one
of them is 0 or 1.  Each step keeps every expectation and the sum of size times probability,
so what a source gives differs from its target by less than one document.

The steps run in a reduction tree: documents are dealt into groups of about ``fan_in`` by a
hash, each group is folded to at most one document that is still fractional, and these meet
in the groups of the next level, until a source has one left, which is rounded at random.
Groups are bounded by the dealing, so a source with a third of all rows is many groups.
Random numbers are hashes of the documents and the seed, so reruns agree.

Defined cases: null texts have size 0 and are taken 0 words; sources go by code point with
null last; ids may repeat or be null (rows are told apart by their place in a group); other
columns are ignored; an empty table mixes to an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.functions.durable import durable
from tidemark.llm.tables import picked, table

WEIGHTS = (5.0, 2.0, 1.0)
#: A source is taken at most so many times.
MAX_REPEATS = 3
FAN_IN = 64
SEED = 20240601
WORD = r"[^\x20\x09-\x0D]+"


def tag_of(doc_id: Column, source: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, source, text, F.lit(SEED))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, tag): tag is a hash that deals documents and seeds their draws."""
    return picked(docs, doc_id="long", text="string", source="string").select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        tag_of(F.col("doc_id"), F.col("source"), F.col("text")).alias("tag"),
    )


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, docs, target), one row for each source.

    Weights repeat over the sources in code-point order.  Targets share the total by weight;
    a source stops at ``MAX_REPEATS`` times its size, and the rest share again: the level
    (words for each unit of weight) rises until no further source stops.  Every turn is one
    aggregate over one row a source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    # one row for each source: the only ordering of a whole table, and it is that small
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    per = durable(per.withColumn("weight", weight), "sources")
    level = 0.0
    while True:
        stopped = F.col("weight") * F.lit(level) > F.lit(MAX_REPEATS) * F.col("source_size")
        total, taken, free = per.agg(
            F.sum("source_size"),
            F.sum(F.when(stopped, MAX_REPEATS * F.col("source_size")).otherwise(0)),
            F.sum(F.when(stopped, 0.0).otherwise(F.col("weight"))),
        ).first()
        new = (total - taken) / free if free else level
        if new <= level:
            break
        level = new
    target = F.least(F.col("weight") * F.lit(level), (MAX_REPEATS * F.col("source_size")).cast("double"))
    return per.select("source", "source_size", "docs", target.alias("target"))


def uniform(*parts) -> Column:
    """A number in [0, 1) from a hash of the parts."""
    return F.pmod(F.xxhash64(*parts, F.lit(SEED)), F.lit(1 << 53)) / F.lit(float(1 << 53))


_OPEN = "struct<tag:bigint,copy:bigint,size:bigint,p:double>"
_DONE = "array<struct<tag:bigint,copy:bigint,x:int>>"


def _pair(state: Column, unit: Column) -> Column:
    """One pivotal step between the fractional document carried so far and the next one."""
    a, b = state["open"], unit
    wa, wb = a["size"].cast("double"), b["size"].cast("double")
    # mass that can flow to a until a is 1 or b is 0, and to b until b is 1 or a is 0 (in words)
    to_a = F.least((1 - a["p"]) * wa, b["p"] * wb)
    to_b = F.least((1 - b["p"]) * wb, a["p"] * wa)
    go_a = uniform(a["tag"], a["copy"], b["tag"], b["copy"]) * (to_a + to_b) < to_b
    a_full, b_full = (1 - a["p"]) * wa <= b["p"] * wb, (1 - b["p"]) * wb <= a["p"] * wa
    a_ends = F.when(go_a, a_full).otherwise(~b_full)
    a_value = F.when(go_a, 1).otherwise(0)
    b_value = F.when(go_a, 0).otherwise(1)
    a_left = F.when(go_a, a["p"] + to_a / wa).otherwise(a["p"] - to_b / wa)
    b_left = F.when(go_a, b["p"] - to_a / wb).otherwise(b["p"] + to_b / wb)
    ended = F.struct(
        F.when(a_ends, a["tag"]).otherwise(b["tag"]).alias("tag"),
        F.when(a_ends, a["copy"]).otherwise(b["copy"]).alias("copy"),
        F.when(a_ends, a_value).otherwise(b_value).cast("int").alias("x"),
    )
    left = F.struct(
        F.when(a_ends, b["tag"]).otherwise(a["tag"]).alias("tag"),
        F.when(a_ends, b["copy"]).otherwise(a["copy"]).alias("copy"),
        F.when(a_ends, b["size"]).otherwise(a["size"]).alias("size"),
        F.when(a_ends, b_left).otherwise(a_left).alias("p"),
    )
    return F.when(
        a.isNull(), F.struct(unit.cast(_OPEN).alias("open"), state["done"].cast(_DONE).alias("done"))
    ).otherwise(
        F.struct(left.cast(_OPEN).alias("open"), F.concat(state["done"], F.array(ended)).cast(_DONE).alias("done"))
    )


def _level(open_units: DataFrame, level: int, fan_in: int) -> DataFrame:
    """Fold each group: the documents that became whole, and the one left open (or null)."""
    groups = F.ceil(F.col("n_open") / F.lit(fan_in)).cast("long")
    dealt = open_units.withColumn("group", F.pmod(F.xxhash64("tag", "copy", F.lit(level)), groups))
    start = F.struct(F.lit(None).cast(_OPEN).alias("open"), F.array().cast(_DONE).alias("done"))
    unit = F.struct("tag", "copy", "size", "p")
    folded = dealt.groupBy("source", "group").agg(
        F.aggregate(F.array_sort(F.collect_list(unit)), start, _pair).alias("state")
    )
    return folded.select("source", "state.open", "state.done")


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, fan_in: int = FAN_IN) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken, tag) for every document."""
    sizes = durable(sized(docs), "sizes")
    targets = source_targets(sizes, weights)
    same = sizes["source"].eqNullSafe(targets["source"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # rows that share a tag are equal rows: numbered so that each is a unit of its own
    units = sizes.join(targets, same).select(sizes["*"], "source_size", "target", "docs", rate.alias("rate"))
    tagged = units.select(
        "*",
        F.floor("rate").cast("long").alias("whole"),
        (F.col("rate") - F.floor("rate")).alias("p"),
    )
    equal = tagged.groupBy("source", "tag", "size", "docs", "p").agg(F.count("*").alias("n")).where("p > 0 and size > 0")
    left = equal.select("source", "tag", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"), "size", "p", F.col("docs").alias("n_open"))
    done = None
    level = 0
    while True:
        out = durable(_level(left, level, fan_in), "rounded")
        whole = out.select(F.explode("done").alias("d")).select("d.*")
        done = whole if done is None else done.union(whole)
        rest = out.where("open is not null").select("source", "open.*")
        count = rest.groupBy("source").agg(F.count("*").alias("n_open"))
        if count.agg(F.max("n_open")).first()[0] in (None, 1):
            break
        left = rest.alias("r").join(count.alias("c"), F.col("r.source").eqNullSafe(F.col("c.source"))).select("r.*", "n_open")
        level += 1
    last = rest.select("tag", "copy", (uniform("tag", "copy", F.lit(-1)) < F.col("p")).cast("int").alias("x"))
    extra = done.union(last).groupBy("tag").agg(F.sum("x").alias("extra"))
    # equal rows share their extra copies in turn
    numbered = tagged.join(extra, "tag", "left").join(equal.groupBy("tag").agg(F.sum("n").alias("n")), "tag", "left")
    turn = F.row_number().over(Window.partitionBy("tag").orderBy("doc_id")) - 1
    share = F.when(F.col("n") > 1, (turn < F.col("extra")).cast("long")).otherwise(F.coalesce("extra", F.lit(0)))
    copies = F.col("whole") + share
    return numbered.select("doc_id", "tag", "size", "source_size", "target", copies.alias("copies")).withColumn(
        "taken", F.col("copies") * F.col("size")
    )


def op2_mixing(spark, sf_dir):
    mixed = mix_documents(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.col("copies").cast("long").alias("copies"))


QUERIES = {"op2_mixing": op2_mixing}
ORACLES: dict[str, str] = {}
