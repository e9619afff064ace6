"""Texts whose polynomial hashes are equal under every odd base are still told apart."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import line_dedup, near_dedup, quality_rules, substring_dedup, suffix_lm
from tidemark.llm import text as X
from tidemark.llm.tables import remainder

DOC = "doc_id long, text string, source string, lang string, n_chars long"
SIGNS = [bin(i).count("1") % 2 for i in range(1024)]
ONE, OTHER = ("".join("ab"[s ^ flip] for s in SIGNS) for flip in (0, 1))


def frame(spark, *texts):
    return spark.createDataFrame([(i, t, "a", "en", 0) for i, t in enumerate(texts, 1)], DOC)


@pytest.mark.parametrize("parts", [1, 2, 16, 32])
def test_span_hash(parts):
    """The pair, whole and cut into shorter spans, next to each other and apart."""
    data = np.frombuffer((ONE + OTHER + ONE).encode(), np.uint8)
    step = 1024 // parts
    start = np.arange(0, len(data), step)
    h = X.span_hash(data, start, start + step, 5)
    text = (ONE + OTHER + ONE).encode()
    words = [text[i : i + step] for i in start]
    assert len(set(h.tolist())) == len(set(words))
    assert all((h[i] == h[j]) == (words[i] == words[j]) for i in range(len(words)) for j in range(0, len(words), 3))


def test_every_length_and_its_prefixes():
    data = np.frombuffer(bytes(range(1, 201)) * 2, np.uint8)
    ends = np.arange(0, 201)
    h = X.span_hash(data, np.zeros_like(ends), ends)
    assert len(set(h.tolist())) == 201
    assert (h == X.span_hash(data, np.full_like(ends, 200), ends + 200)).all()
    assert (h[1:] != X.span_hash(data, np.zeros_like(ends), ends, seed=2)[1:]).all()
    assert len(X.span_hash(data[:0], ends[:0], ends[:0])) == 0


def test_line_dedup(spark):
    got = {r.doc_id: r for r in line_dedup.dedup_lines(frame(spark, ONE, OTHER, "x\n" + ONE)).collect()}
    assert [got[i].n_dropped for i in (1, 2, 3)] == [0, 0, 1]


def test_near_dedup(spark):
    tail = " ".join("cdefgh")
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(frame(spark, f"{ONE} {tail[:5]}", f"{OTHER} {tail[:5]}"), width=4).collect()}
    assert got == {1: 1, 2: 2}


def test_quality(spark):
    row = quality_rules.quality(frame(spark, f"{ONE}\n{OTHER}\n{ONE}")).first()
    assert row.n_dup_lines == 1


def test_substring(spark):
    rest = " ".join(f"w{i}" for i in range(20))
    got = {r.doc_id: r for r in substring_dedup.drop_repeats(frame(spark, f"{ONE} " + rest, f"{OTHER} " + rest)).collect()}
    assert got[2].n_removed == 20 and got[1].n_removed == 0
    assert got[2].kept_sha256 == hashlib.sha256(OTHER.encode()).hexdigest()
    # without the rest nothing is shared
    twelve = " ".join(f"w{i}" for i in range(12))
    got = {r.doc_id: r for r in substring_dedup.drop_repeats(frame(spark, f"{ONE} {twelve}", f"{OTHER} {twelve}")).collect()}
    assert got[1].n_removed == got[2].n_removed == 0


def test_lm_counts_the_other_word_as_unknown(spark):
    held = [i for i in range(1, 60) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [(i, OTHER if i in held else ONE, "a", "en", 0) for i in range(1, 60)]
    got = suffix_lm.lm_scores(spark.createDataFrame(rows, DOC), remainder("doc_id", 10) == 0)
    known = {r.held_out: r.known for r in got.groupBy("held_out").agg(F.max("n_known").alias("known")).collect()}
    assert known == {True: 1, False: 2}
