"""A corpus pipeline of five of the training-data operators, each stage written and read again.

Quality rules reject documents, line dedup takes lines out of texts, near-dedup keeps one
document of each group, decontamination drops documents that hold a benchmark window, and
mixing repeats or leaves out documents until sources have their target weights.

Defined cases: rows without an id have no group in near-dedup and stay; rows that share id and
text are one document there; a document whose lines all go stays as an empty text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.durable import durable
from tidemark.llm import decontaminate, line_dedup, mixing, near_dedup, quality_rules
from tidemark.llm.tables import picked, table

COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
OTHERS = {"lang": "string", "source": "string", "n_chars": "long"}


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go."""
    return quality_rules.passing(picked(docs, **COLUMNS))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has go; n_chars follows the text."""
    kept = line_dedup.dedup_lines(docs, lang="string", source="string")
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    docs = picked(docs, **COLUMNS)
    names = durable(near_dedup.near_groups(docs).where("kept and doc_id is not null").select("doc_id").distinct(), "kept")
    named = docs.join(names, "doc_id", "left_semi").withColumn("mark", F.xxhash64("text")).dropDuplicates(["doc_id", "mark"]).drop("mark")
    return named.select(*COLUMNS).union(docs.where("doc_id is null").select(*COLUMNS))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark window occurs go."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), **OTHERS)
    return found.where(F.size("items") == 0).select(*COLUMNS)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, with the number of the copy."""
    docs = picked(docs, **COLUMNS)
    # equal rows share a tag, so their copies add up
    copies = mixing.mix_documents(docs).where("copies > 0").groupBy("tag").agg(F.sum("copies").alias("copies"))
    one = docs.withColumn("tag", mixing.tag_of(F.col("doc_id"), F.col("source"), F.col("text"))).dropDuplicates(["tag"])
    taken = one.join(copies, "tag")
    return taken.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", lines_stage),
    ("near dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("mixing", mix_stage),
]

#: Mixing draws by hashes that SQL elsewhere doesn't have; the operators behind the stages have tests of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
