"""Language profiles, source divergence and the Merkle manifest against plain Python."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import divergence, language_id, merkle

DOC = "doc_id long, text string, source string, lang string, n_chars long, tree string, digest string, term string"
ENGLISH, GERMAN = "the cat and the dog sat there with that other", "der hund und die katze sind nicht in dem haus"


def frame(spark, rows):
    """rows: (doc_id, text, source, lang); further columns carry names the operators use inside."""
    return spark.createDataFrame([(*r, None if r[0] == 3 else 7, "x", "y", "z") for r in rows], DOC)


ROWS = [
    (1, ENGLISH, "a", "en"), (2, GERMAN, "b", "de"), (3, None, None, None), (4, "", "", "en"), (5, " \n 12 !", "a", "de"),
    (6, ENGLISH.upper() + " Ünïcode", "b", "en"), (6, ENGLISH.upper() + " Ünïcode", "b", "en"), (None, GERMAN, "a", "de"),
    (8, ENGLISH, "c", "en"), (9, (GERMAN + " ") * 3000, "ü", "de"), (10, "Zz zz ZZ", None, "en"), (11, "x", "a", "en"),
    (-12, GERMAN, "ü", ""), (13, "漢字 かな", "b", "ja"), (14, ENGLISH, "b", "en"), (15, "İstanbul", "b", None),
]


# ------------------------------------------------------------------ language profiles


def grams(text):
    out = Counter()
    for w in re.split("_+", "".join(c if c.isalpha() else "_" for c in (text or "").lower())):
        padded = f"_{w}_"
        out.update(padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1) if w and padded[i : i + n] != "_")
    return out


def rank_order(counts):
    code = lambda g: (len(g), [1 if c == "_" else ord(c) for c in g])
    return {g: k for k, g in enumerate(sorted(counts, key=lambda g: (-counts[g], code(g)))[: language_id.TOP])}


def plain_languages(rows):
    fold = lambda i: None if i is None else zlib.crc32(str(i).encode()) % 5
    seen = defaultdict(Counter)
    for i, t, _, lang in rows:
        if lang is not None and fold(i) not in (None, 0):
            seen[lang] += grams(t)
    profiles = {lang: rank_order(c) for lang, c in seen.items() if c}
    out = []
    for i, t, _, _ in rows:
        mine = rank_order(grams(t))
        far = sorted((sum(abs(k - p[g]) if g in p else language_id.TOP for g, k in mine.items()), lang.encode(), lang) for lang, p in profiles.items())
        if not mine or not far:
            out.append((i, fold(i) == 0, "und", 0.0))
            continue
        agree = [1 - d / (len(mine) * language_id.TOP) for d, _, _ in far[:2]]
        out.append((i, fold(i) == 0, far[0][2], agree[0] / sum(agree) if sum(agree) else 0.5))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))


def test_ngrams_of_mixed_texts():
    texts = ["Hello wörld's end", None, "", "a", "  ü_É 12 x", "漢字かな交じり文 " * 3, "İI ab ab", "ab" * 50, "-", "\0a\0"]
    owner, keys, count = language_id.counted(texts)
    key = lambda g: sum((1 if c == "_" else ord(c)) << (21 * (len(g) - 1 - k)) for k, c in enumerate(g))
    for i, t in enumerate(texts):
        assert dict(zip(keys[owner == i].tolist(), count[owner == i].tolist(), strict=True)) == {key(g): n for g, n in grams(t).items()}, t
    o, k, rank = language_id.ranked(owner, keys, count)
    for i, t in enumerate(texts):
        assert k[o == i].tolist() == [key(g) for g in rank_order(grams(t))] and rank[o == i].tolist() == list(range((o == i).sum()))
    # an alphabet too wide for one number per (text, n-gram) is counted in halves
    wide = ["".join(chr(0x4E00 + j) for j in range(i, 20000, 3)) for i in range(3)] + ["é"] * 20000
    assert [c.sum() for c in (language_id.counted(wide)[2],)] == [sum(sum(grams(t).values()) for t in wide[:3]) + 20000 * 4]


def test_languages(spark):
    got = ordered((r.doc_id, r.held_out, r.lang_pred, r.score) for r in language_id.languages(frame(spark, ROWS)).collect())
    for g, w in zip(got, ordered(plain_languages(ROWS)), strict=True):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3]), (g, w)
    assert language_id.languages(frame(spark, [])).count() == 0
    unlabelled = language_id.languages(frame(spark, [(i, t, s, None) for i, t, s, _ in ROWS])).select("lang_pred", "score").distinct().collect()
    assert [tuple(r) for r in unlabelled] == [("und", 0.0)]


def test_more_languages_than_one_pass_holds(spark):
    """Names beyond a block take part in the next pass; the nearest of all is found, first by name."""
    rows = [(i, f"word{'abcdefghij'[i % 10]} " * 5 + chr(97 + i % 26) * 3, "a", f"L{i:04d}") for i in range(1, 1300)]
    assert len({r[3] for r in rows}) > 2 * language_id.BLOCK
    got = ordered((r.doc_id, r.held_out, r.lang_pred, r.score) for r in language_id.languages(frame(spark, rows)).collect())
    want = ordered(plain_languages(rows))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(g[3] == pytest.approx(w[3]) for g, w in zip(got, want, strict=True))


# ------------------------------------------------------------------ source divergence


def plain_audit(rows):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    lang_n, docs, group_n = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for _, t, source, lang in rows:
        g = (lang or "", source or "")
        found = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(t or "")))
        lang_n[g[0]] += found
        docs[g[0]].update(found.keys())
        group_n[g] += found
    out = []
    for lang, source in group_n:
        kept = {t: lang_n[lang][t] for t, n in docs[lang].items() if n >= divergence.MIN_DOCS}
        p = {s: {t: 1 + divergence.SCALE * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept} for (g, s), c in group_n.items() if g == lang}
        q = {t: 1 + divergence.SCALE * (n + 1) // (sum(kept.values()) + len(kept)) for t, n in kept.items()}
        mine = p[source]
        pairs = [(-sum((mine[t] - o[t]) ** 2 // o[t] for t in kept), s.encode(), s) for s, o in p.items() if s != source]
        terms = [(-((mine[t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if group_n[lang, source][t] and mine[t] > q[t]]
        out += [(lang, source, "pair", item, -v, k) for k, (v, _, item) in enumerate(sorted(pairs), 1)]
        out += [(lang, source, "term", item, -v, k) for k, (v, _, item) in enumerate(sorted(terms)[: divergence.RANKS], 1)]
    return sorted(out)


def test_audit(spark):
    # ties: many terms of equal counts, more than the ranks hold, in several sources
    tied = " ".join(f"t{chr(97 + i // 26)}{chr(97 + i % 26)}é" for i in range(300))
    rows = ROWS + [(100 + i, tied + " extra" * i, "ae"[i % 2], "en") for i in range(5)] + [(200 + i, "common " * 2000, "z", "en") for i in range(3)] + [(300, "only once", "lone", "fr")]
    got = divergence.audit(frame(spark, rows))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = sorted(tuple(r) for r in got.collect())
    want = plain_audit(rows)
    assert got == want
    assert max(r[5] for r in want if r[2] == "term") == divergence.RANKS
    assert divergence.audit(frame(spark, [])).count() == 0
    # languages without kept terms: pairs of value 0
    few = [(1, "x y", "a", "fr"), (2, None, None, "fr"), (3, "x", "c", "fr")]
    assert sorted(tuple(r) for r in divergence.audit(frame(spark, few)).collect()) == plain_audit(few)


def test_pair_sums_in_slices(monkeypatch):
    """A matrix of few terms at a time, over several ranges, gives the sums of the whole."""
    import random

    rng = random.Random(5)
    names = [f"s{i}" for i in range(4)]
    p = {(t, s): rng.randint(1, 10**9) for t in range(50) for s in names}
    present = {k for k in p if rng.random() < 0.6}
    zero = {s: i + 1 for i, s in enumerate(names)}
    monkeypatch.setattr(divergence, "CELLS", 12)
    sums = divergence.PairSums("en")
    for bucket in (0, 1):
        for s in names:
            sums.head(s, zero[s])
        sums.ready()
        for t in range(bucket * 25, bucket * 25 + 25):
            for s in names:
                if (t, s) in present:
                    sums.add(str(t), s, p[t, s])
    terms = {t for t, _ in present}
    value = lambda t, s: p[t, s] if (t, s) in present else zero[s]
    for r in sums.result().to_pylist():
        assert r["value"] == sum((value(t, r["source"]) - value(t, r["item"])) ** 2 // value(t, r["item"]) for t in terms)


# ------------------------------------------------------------------ Merkle manifest


def H(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_tree(nodes):
    """(root, [(left, right) by level] of each leaf)."""
    at, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for leaf, k in enumerate(at):
            run = runs[k // 16]
            paths[leaf].append(("".join(run[: k % 16]), "".join(run[k % 16 + 1 :])))
        nodes, at = [H("".join(r)) for r in runs], [k // 16 for k in at]
    return nodes[0], paths


def plain_manifest(rows):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, t, s, g, n: H(enc(i) + enc(s) + enc(g) + enc(n) + enc(t))
    sources = defaultdict(list)
    for i, t, s, g in rows:
        n = None if i == 3 else 7
        own = leaf(i, t, s, g, n)
        hit = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        low = t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        sources[s].append((i is not None, i or 0, own, i, leaf(i, low, s, g, n) if hit else own))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in sorted(sources[s])]) for s in names}
    root, tops = plain_tree([trees[s][0] for s in names])
    out = []
    for s, top in zip(names, tops, strict=True):
        for (_, _, own, i, node), path in zip(sorted(sources[s]), trees[s][1], strict=True):
            path = path + top
            proof = H("".join(a + b for a, b in path))
            for a, b in path:
                node = H(a + node + b)
            out.append((i, own, trees[s][0], root, proof, node, node == root))
    return sorted(out, key=str)


def check_manifest(spark, rows):
    got = merkle.manifest(frame(spark, rows))
    assert got.columns == ["doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sorted((tuple(x for k, x in enumerate(r) if k != 1) for r in got.collect()), key=str)
    want = plain_manifest(rows)
    assert got == want
    return want


def test_manifest(spark):
    want = check_manifest(spark, ROWS)
    assert any(not r[6] for r in want) and any(r[6] for r in want)
    check_manifest(spark, [(1, "A", "s", None)])  # one leaf is the root
    assert merkle.manifest(frame(spark, [])).count() == 0


@pytest.mark.parametrize("n", [16, 17, 256, 257, 4096, 4097, 9000])
def test_manifest_of_many_leaves(spark, n):
    """Runs and blocks that end early, also with a single node; a source of more than one block."""
    rows = [(i * 3, f"Text {i}", "hot", "en") for i in range(n)] + [(i, "T", f"s{i % 20:02d}", "de") for i in range(60)]
    check_manifest(spark, rows)


def test_many_sources(spark):
    check_manifest(spark, [(i, f"T{i}", f"source {i}", "en") for i in range(5000)])


def test_witnesses_grow_with_later_siblings():
    block = merkle.Subtrees(2)
    paths = []
    for i in range(33):
        paths.append(block.append(H(str(i))))
        assert len(paths[0]) == (0 if i < 15 else 2)
    root = block.close()
    assert {merkle.folded(H(str(i)), p) for i, p in enumerate(paths)} == {root}
    assert len(paths[32]) == 4 and paths[32][:2] == ["", ""]


def test_tampering_any_leaf_is_seen(spark):
    rows = [(i, f"UPPER {i}", "ab"[i % 2], "en") for i in range(100)]
    got = {r.doc_id: r.verified for r in merkle.manifest(frame(spark, rows)).select("doc_id", F.col("verified")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 != 0 for i in range(100)}
