"""Small cases of each operator against brute force: nulls, empty, long and repeated rows."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, line_dedup, mixing, near_dedup, quality_rules, substring_dedup, suffix_lm, toxicity, warc, wrappers
from tidemark.llm.tables import components, remainder

DOC = "doc_id long, text string, source string, lang string, n_chars long, mark string, doc string"
LONG = " ".join(f"w{i % 700}" for i in range(4000))
BASE = " ".join(f"tok{i}" for i in range(80))
TEXTS = [
    (1, BASE + "\nShared line of text here\nlast", "a"),
    (2, BASE.replace("tok7 ", "other ") + "\n  shared LINE of text here \nshared line of text here", "b"),
    (3, None, None),
    (4, "", "a"),
    (5, "   \n\t", "c"),
    (6, "one two", "b"),
    (7, "one two", "a"),
    (7, "one two", "a"),
    (None, BASE, "a"),
    (8, LONG, "ü"),
    (9, "é" * 9 + "\n" + "é" * 10 + "\n" + "é" * 10, "a"),
    (10, "\n" + "é" * 10, "c"),
    (11, "ha " * 60, "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, s, "en", 0, "clash", "clash") for i, t, s in TEXTS], DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def words(t):
    return (t or "").encode().split()


def by_id(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))


def expected_order():
    return sorted(TEXTS, key=lambda r: (r[0] is None, r[0] or 0))


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (7, 8), (8, 7), (2, 2)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {3: 3, 4: 3, 5: 3, 9: 3, 7: 7, 8: 7}


def test_quality(docs, none):
    assert quality_rules.quality(none).count() == 0
    for r, (_, t, _) in zip(by_id(quality_rules.quality(docs)), expected_order(), strict=True):
        w = words(t)

        def cover(k, w=w):
            grams = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
            seen = Counter(grams)
            return {j for i, g in enumerate(grams) if seen[g] > 1 for j in range(i, i + k)}

        longest = next((k for k in range(len(w), 0, -1) if cover(k)), 0)
        lines = [x for x in (t or "").split("\n") if x.split()]
        assert r["n_words"] == len(w) and r["n_repeat_words"] == len(cover(3)) and r["n_covered"] == len(cover(8))
        assert r["longest_repeat"] == longest and r["n_dup_lines"] == len(lines) - len(set(lines))
        bad = len(w) < 50 or 2 * len(cover(3)) > len(w)
        assert r["base_failed"] == bad and r["kept"] == (not bad and 100 * len(cover(8)) <= 30 * len(w) and longest <= 100)


def brute_lines(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    owner, holders = {}, {}
    for i, t, _ in rows:
        i = line_dedup.LAST if i is None else i
        for x in (t or "").split("\n"):
            owner[key(x)] = min(owner.get(key(x), i), i)
            holders.setdefault(key(x), set()).add(i)
    for i, t, _ in rows:
        i = line_dedup.LAST if i is None else i
        keep = [x for x in (t or "").split("\n") if len(key(x)) < 10 or len(holders[key(x)]) < 2 or owner[key(x)] == i]
        yield len((t or "").split("\n")), hashlib.sha256("\n".join(keep).encode()).hexdigest()


def test_lines(docs, none):
    assert line_dedup.dedup_lines(none).count() == 0
    got = by_id(line_dedup.dedup_lines(docs))
    assert [(r["n_lines"], r["kept_sha256"]) for r in got] == list(brute_lines(expected_order()))


def test_hot_line_over_partitions(spark):
    rows = [(i, "the very same line everywhere\nown line number " + str(i), "a", "", 0, "", "") for i in range(400)]
    got = by_id(line_dedup.dedup_lines(spark.createDataFrame(rows, DOC).repartition(8)))
    assert [r["n_dropped"] for r in got] == [0] + [1] * 399


def test_near(spark, docs, none):
    assert near_dedup.near_groups(none).count() == 0
    for limit in (near_dedup.CLUSTER_SHINGLES, 60):
        got = by_id(near_dedup.near_groups(docs, width=4, cluster_shingles=limit))
        assert [(r["doc_id"], r["component_id"], r["kept"]) for r in got] == [
            (1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True), (5, 5, True), (6, 6, True), (7, 6, False), (7, 6, False),
            (8, 8, True), (9, 9, True), (10, 10, True), (11, 11, True), (None, None, True)]


def test_decontamination_in_blocks(spark, docs, none):
    bench = spark.createDataFrame([("x", BASE.upper()[:120], 1), ("y", "One, two!", 1), ("z", None, 1), (None, BASE, 1)], "item_id string, text string, doc_id int")
    assert decontaminate.contamination(none, bench).count() == 0
    once = by_id(decontaminate.contamination(docs, bench))
    blocks = by_id(decontaminate.contamination(docs, bench, block_windows=2))
    assert once == blocks
    hits = {r["doc_id"]: (len(r["spans"]) // 4, r["items"]) for r in once}
    assert hits[6] == (2, ["y"]) and hits[8] == (0, []) and hits[3] == (0, []) and hits[1][1] == ["x"]


def test_mixing(spark, docs, none):
    assert mixing.mix_documents(none).count() == 0
    rows = [(i, "w " * (1 + i % 37), "s" + str(i % 4 if i % 3 else 0), "", 0, "", "") for i in range(600)]
    df = spark.createDataFrame(rows, DOC)
    got = by_id(mixing.mix_documents(df, fan_in=8))
    assert got == by_id(mixing.mix_documents(df, fan_in=8))
    for s in {r[2] for r in rows}:
        mine = [g for g, r in zip(got, rows, strict=True) if r[2] == s]
        assert abs(sum(g["taken"] for g in mine) - mine[0]["target"]) <= 37
    assert all(0 <= g["taken"] <= 3 * g["size"] for g in got)
    assert len(by_id(mixing.mix_documents(docs))) == len(TEXTS)


def test_targets(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1), (None, 100)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    # weights 5, 2, 1 of 111: a stops at 30, b at 3, the rest goes to the last
    assert got == {"a": 30.0, "b": 3.0, None: 78.0}


def test_substring(spark, docs, none):
    assert substring_dedup.drop_repeats(none).count() == 0
    rows = expected_order()
    first: dict = {}
    ident = lambda i: substring_dedup.LAST if i is None else i
    for i, t, _ in rows:
        w = words(t)
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            first[g] = min(first.get(g, ident(i)), ident(i))
    for cells in (30, 4):  # a full sketch only loses its saving
        for r, (i, t, _) in zip(by_id(substring_dedup.drop_repeats(docs, max_cell_bits=cells)), rows, strict=True):
            w = words(t)
            gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < ident(i) for j in range(k, k + 13)}
            kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
            assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(w), len(gone), hashlib.sha256(kept).hexdigest())


def test_lm(docs, none):
    assert suffix_lm.lm_scores(none, remainder("doc_id", 10) == 0).count() == 0
    got = by_id(suffix_lm.lm_scores(docs, remainder("doc_id", 10) == 0))
    tokens = [[w.lower() for w in words(t)] + [None] for _, t, _ in expected_order()]
    held = [i is None or zlib.crc32(str(i).encode()) % 10 == 0 for i, _, _ in expected_order()]
    c = Counter(w for ts, h in zip(tokens, held, strict=True) if not h for w in ts)
    n, v = sum(c.values()), len(c)
    for r, ts, h in zip(got, tokens, held, strict=True):
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ts)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (h, len(ts), sum(c[w] > 0 for w in ts), n)
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0


def test_states_are_distributions():
    import numpy as np

    tree = suffix_lm.Tree([(0, 0, 97, 5), (0, 0, 98, 3), (1, 97, 98, 3), (0, 0, 10, 2)]).open()
    share = 10.0 ** tree.log.astype(float)
    others = 256 - (share.shape[1] - 1)
    assert np.allclose(share[:, :-1].sum(1) + others * share[:, -1], 1, atol=1e-4)


def plain_lm_scores(texts, held):
    """Scores from plain counts: {text: score}; texts maps each text to its number of rows."""
    d, end, fill = suffix_lm.DEPTH, chr(suffix_lm.END), chr(suffix_lm.FILL)
    line = lambda t: fill * (d - 1) + end + "".join(w.lower().decode("latin-1") + " " for w in words(t)) + end
    seen, word, total = [Counter() for _ in range(d + 1)], Counter(), 0
    for t, k in texts.items():
        if not held(t):
            s = line(t)
            for i in range(d, len(s)):
                for n in range(d + 1):
                    seen[n][s[i - n : i], s[i]] += k
            word.update({w: c * k for w, c in Counter([w.lower() for w in words(t)] + [None]).items()})
    total = sum(word.values())
    ctx = [Counter() for _ in seen]
    for n, x in enumerate(seen):
        for (c, _), k in x.items():
            ctx[n][c] += k
    gain = Counter()
    for n in range(1, d + 1):
        for (c, a), k in seen[n].items():
            if ctx[n][c] >= suffix_lm.MIN_COUNT and c[0] != fill:
                gain[c] += k / ctx[n][c] * math.log2(k / ctx[n][c] / (seen[n - 1][c[1:], a] / ctx[n - 1][c[1:]]))
    kept = {c[i:] for c, g in gain.items() if g >= suffix_lm.MIN_GAIN for i in range(len(c))}

    def p(c, a):
        if not c:
            return (seen[0]["", a] + 0.5) / (ctx[0][""] + 128)
        up = p(c[1:], a)
        return (seen[len(c)][c, a] + suffix_lm.PRIOR * up) / (ctx[len(c)][c] + suffix_lm.PRIOR) if c in kept else up

    out = {}
    for t in texts:
        s, i, score = line(t), d, 0.0
        for w in [*words(t), None]:
            size = 1 if w is None else len(w) + 1
            states = math.prod(p(s[j - d : j], s[j]) for j in range(i, i + size))
            i += size
            share = word[w and w.lower()] / max(total, 1)
            score += math.log10(suffix_lm.WORD_SHARE * share + (1 - suffix_lm.WORD_SHARE) * states)
        out[t] = score
    return out, kept


def test_lm_from_plain_counts(spark):
    """Contexts seen 36 times among six million symbols are states, as in a small corpus."""
    is_held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    held = [i for i in range(9000) if is_held(i)]
    free = [i for i in range(9000) if not is_held(i)]
    often, rare = "the sea and the sand Über " * 80, "qzxjv kwyzq " * 6
    rows = [(i, often) for i in free[:3000]] + [(i, rare) for i in free[3000:3006]] + [(free[3006], None), (free[3007], "one two")]
    rows += list(zip(held, ["qzxjq kwyz", "sea", "unseen ß words", "Qzxjv the kwyzq"], strict=False))
    df = spark.createDataFrame([(i, t, "a", "en", 0, "", "") for i, t in rows], DOC)
    ids = {t or "": i for i, t in rows}
    want, kept = plain_lm_scores(Counter(t or "" for _, t in rows), lambda t: is_held(ids[t]))
    assert "qz" in kept
    got = {r["doc_id"]: r["score"] for r in suffix_lm.lm_scores(df, remainder("doc_id", 10) == 0).collect()}
    for i, t in rows:
        assert got[i] == pytest.approx(want[t or ""], rel=1e-5)


def test_toxicity(spark, none):
    rows = [(i, ("you idiot fool " if i % 5 == 0 else "nice calm day ") + f"word{i % 7} other", "a", "", 0, "", "") for i in range(300)]
    rows += [(1000, None, None, None, None, None, None), (None, "idiot", "a", "", 0, "", "")]
    df = spark.createDataFrame(rows, DOC)
    labels = spark.createDataFrame([(i, int(i % 5 == 0), 1) for i in range(0, 300, 2)] + [(None, 1, 1), (4, None, 1)], "doc_id long, toxic int, quality int")
    got = by_id(toxicity.toxicity(df, labels, remainder("doc_id", 5) == 0))
    assert len(got) == len(rows)
    assert all(r["predicted"] == int(r["doc_id"] % 5 == 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 300)
    assert toxicity.toxicity(none, labels, remainder("doc_id", 5) == 0).count() == 0
    assert {r["score"] for r in by_id(toxicity.toxicity(df, labels.limit(0), remainder("doc_id", 5) == 0))} == {0.0}


def test_rare_toxic_copy(spark):
    """A near copy of a toxic example finds it by words that only this example has."""
    rows = [(i, ("you idiot fool " if i % 3 == 0 else "nice calm day ") + f"word{i % 7} other", "a", "", 0, "", "") for i in range(1, 200)]
    rows += [(1001, "vile brute scum other", "a", "", 0, "", ""), (1002, "Vile brute scum word3", "a", "", 0, "", "")]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(1, 200)] + [(1001, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(spark.createDataFrame(rows, DOC), labels, F.lit(False)).collect()}
    assert got[1002].evidence[0] == 1001 and got[1002].cosines[0] > 0.5
    assert got[2].predicted == 0 and got[3].predicted == 1


def test_nearest_is_exact():
    import numpy as np

    rng = np.random.default_rng(3)
    n, v = 500, 40
    dense = rng.poisson(0.15, (n, v))
    row, term = np.nonzero(dense)
    idf = rng.uniform(1, 4, v)
    index = toxicity.Index(toxicity.Terms(list(range(v))), idf, list(range(n)), [0] * n, (row, term, dense[row, term]))
    full = np.where(dense > 0, 1 + np.log(np.maximum(dense, 1)), 0) * idf
    full /= np.maximum(np.linalg.norm(full, axis=1, keepdims=True), 1e-12)
    for q in range(0, n, 9):
        t = np.flatnonzero(dense[q])
        if len(t):
            _, cos = index.nearest(t, full[q, t], 25)
            want = np.sort(np.round(full @ full[q], 12))[::-1][:25]
            assert np.allclose(cos, want[want > 0][: len(cos)]) and len(cos) == (want > 0).sum()


PAGES = [
    (1, "http://h.example/1", "<p>same\r\n\r\n</p>"), (2, "http://h.example/2", "<p>same\r\n\r\n</p>"), (2, "http://h.example/2", "<p>same\r\n\r\n</p>"),
    (3, None, None), (4, "u", ""), (None, "x y", "<p>é\n\r\n"), (5, "http://z/", "WARC/1.1\r\n\r\n" * 3), (6, "http://z/", "x" * 300_000),
]
PAGE = "page_id long, url string, html string, digest string, row string"


def test_warc(spark, tmp_path):
    df = spark.createDataFrame([(*p, "clash", "clash") for p in PAGES], PAGE)
    warc.write_warc(df.repartition(3), str(tmp_path / "a"))
    records = warc.read_warc(spark, str(tmp_path / "a"), with_payload=True)
    kinds = Counter(r.type for r in records.collect())
    assert kinds["request"] == kinds["metadata"] == len(PAGES) and kinds["response"] == 5
    got = warc.transactions(records).collect()
    assert len(got) == len(PAGES)
    html = {digest: x or "" for _, _, x in PAGES for digest in [warc.digest((x or "").encode())]}
    for r in got:
        if r.response.type == "response":
            assert r.response.payload == html[r.response.payload_digest]
        else:
            assert r.original.page_id == {1: 2, 2: 2, 3: 4}[r.metadata.page_id]
    warc.write_warc(df.limit(0), str(tmp_path / "b"))
    assert warc.transactions(warc.read_warc(spark, str(tmp_path / "b"))).count() == 0


def test_wrappers(spark):
    page = lambda k: (
        f"<html><head><title>t{k}</title><style>p{{}}</style></head><body class='no-sidebar'><nav>menu {k}</nav><div class='cookie-notice'>ok?</div>"
        f"<div class='content'><h1>Head {k}</h1><p>Body &amp; text\n {k}<p>More<br>lines<div class='ad-box'>buy {k}</div><p>Share with friends</div>"
        f"<section id='comments'><p>me too {k}</p></section><form>f</form><footer>foot</footer><script>x<y</script></body></html>"
    )
    rows = [(k, "http://h.example/a", page(k), "", "") for k in range(8)]
    rows += [(90, None, None, "", ""), (91, "::", "plain &lt;b&gt;", "", ""), (92, "http://o/", "<article>A<header>h</header><p>B" + "<div>" * 900 + "deep", "", "")]
    got = {r.page_id: r.text for r in wrappers.main_text(spark.createDataFrame(rows, PAGE)).collect()}
    # "More" and what follows it on every page is the host's template
    assert got[3] == "Head 3 Body & text 3" and got[90] == "" and got[91] == "plain <b>" and got[92] == "A B deep"
    assert wrappers.main_text(spark.createDataFrame([], PAGE)).count() == 0


def test_tree_matching():
    a = ["div", [["p", []], ["ul", [["li", []]]], ["p2", []]]]
    b = ["div", [["ul", [["li", []]]], ["h1", []], ["p2", []]]]
    assert wrappers.matching(a, b)[0] == 4
    assert wrappers.align(a, b) == ["div", [["p", []], ["ul", [["li", []]]], ["h1", []], ["p2", []]]]


def test_pipeline(spark):
    import corpus_pipeline as C

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {r.doc_id for r in quality_rules.quality(docs).where("kept").collect()}
    for name, stage in C.STAGES[:4]:
        out = stage(spark, docs, d)
        assert out.columns == list(C.COLUMNS)
        if name == "quality rules":
            assert {r.doc_id for r in out.collect()} == kept
        assert stage(spark, docs.limit(0), d).count() == 0, name
    assert C.run(spark, d).columns == [*C.COLUMNS, "copy"]


def test_toxicity_sums_lists_without_a_slice_a_term():
    """Lists are summed in one go: a query of many rare terms makes no piece of its own for each."""
    import numpy as np

    from tidemark.llm import toxicity as T

    rng, terms, docs = np.random.default_rng(5), 20_000, 400
    has = [np.unique(rng.integers(0, terms, 300)) for _ in range(docs)]
    ex = np.repeat(np.arange(docs), [len(x) for x in has])
    index = T.Index(T.Terms(np.arange(terms)), np.ones(terms), np.arange(docs), np.arange(docs) % 2, (ex, np.concatenate(has), np.ones(len(ex), int)))
    index.open()
    assert index.lists[0].dtype == np.intp  # no cast at every sum
    q = np.arange(terms)
    w = np.full(terms, 1 / np.sqrt(terms))
    plain = np.round([w[x].sum() / np.sqrt(len(x)) for x in has], 12)
    place, score = index.nearest(q, w, 25)
    order = np.lexsort((np.arange(docs), -plain))[:25]
    assert np.allclose(score, plain[order], atol=2e-12) and set(place) == set(order)
    assert len(index.nearest(q[:0], w[:0], 25)[0]) == 0


def test_toxicity_finds_terms_by_leading_bits():
    """The same places as a plain search, also where many keys share their leading bits."""
    import numpy as np

    from tidemark.llm import toxicity as T

    rng = np.random.default_rng(7)
    top = np.iinfo(np.uint64).max
    for keys in (rng.integers(0, top, 3000, np.uint64), np.arange(500, dtype=np.uint64), np.array([0, 5, top], np.uint64), np.array([], np.uint64)):
        terms = T.Terms(keys.view(np.int64))
        h = np.concatenate([keys, keys + np.uint64(1), rng.integers(0, top, 2000, np.uint64), np.array([0, top], np.uint64)])
        at, ok = terms.find(h)
        assert np.array_equal(at, np.searchsorted(terms.keys, h)) and np.array_equal(ok, np.isin(h, keys))


def test_toxicity_index_is_small():
    """Sent: a term and a small count a cell; opened: eight bytes a cell of the lists. Nothing is lost by it."""
    import numpy as np

    from tidemark.llm import toxicity as T

    rng = np.random.default_rng(9)
    ex, term = np.nonzero(rng.random((300, 900)) < 0.02)
    index = T.Index(T.Terms(np.arange(900)), rng.uniform(1, 5, 900), np.arange(300), np.arange(300) % 2, (ex, term, rng.integers(1, 4, len(ex)))).open()
    assert sum(x.nbytes for x in index.lists) == 8 * len(index.term)
    sent = index.__getstate__()
    assert sent["count"].itemsize == 1 and sum(x.nbytes for x in sent.values() if isinstance(x, np.ndarray) and len(x) == len(ex)) == 5 * len(ex)
    dense = np.zeros((len(index.ids), 900))
    dense[np.repeat(np.arange(len(index.ids)), np.diff(index.edge)), index.term] = index.weight
    for i in range(0, len(dense), 7):
        t = np.flatnonzero(dense[i])
        full = np.round(dense @ dense[i], 12)
        full[i] = 0
        order = np.lexsort((np.arange(len(full)), -full))[:25]
        place, score = index.nearest(t, dense[i, t], 25, but=index.ids[i])
        order = order[full[order] > 0]
        assert np.allclose(score, full[order], atol=2e-12) and set(place[score > score[-1]]) <= set(order)


def test_toxicity_judges_each_example_once(spark):
    """No exchange by ranges above the examples' votes: Spark runs what lies below one twice."""
    import numpy as np

    from tidemark.llm import toxicity as T

    words = np.array([T.words_in(np.frombuffer(x, np.uint8), np.array([0, len(x)])).hashes()[0] for x in (b"idiot", b"calm", b"day")]).view(np.int64)
    terms = T.Terms(words)
    texts = ["idiot day", "calm day", "idiot", "calm calm", "nothing known"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    index = T.Index(terms, np.array([2.0, 2.0, 1.0])[np.argsort(words.view(np.uint64))], range(5), [1, 0, 1, 0, 0], terms.counts(data, off))
    examples = spark.createDataFrame([(i, int("idiot" in x), x) for i, x in enumerate(texts)], "doc_id long, toxic int, text string")
    out = T.own_votes(examples, spark.sparkContext.broadcast(index))
    got = sorted((r.v, r.y) for r in out.collect())
    assert len(got) == 4  # a text without a term has no vote
    assert max(v for v, y in got if not y) < min(v for v, y in got if y)
    assert "rangepartitioning" not in out._jdf.queryExecution().toString()


def test_toxicity_fit_does_not_hang_on_order():
    import numpy as np

    from tidemark.llm import toxicity as T

    rng = np.random.default_rng(4)
    v, y = rng.integers(0, 6, 400) / 6, rng.integers(0, 2, 400).astype(float)
    mixed = rng.permutation(400)
    for a, b in zip(T.monotone(v, y), T.monotone(v[mixed], y[mixed]), strict=True):
        assert np.array_equal(a, b)
