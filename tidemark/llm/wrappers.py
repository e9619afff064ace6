"""HTML extraction by wrapper induction.

1. Every page becomes a DOM tree.  Runs of equal siblings (list items, paragraphs) fold to one
   node, so a page's skeleton is small and pages of one template share it.
2. Skeletons are counted for each host in Spark, and a host's distinct skeletons are aligned
   by simple tree matching, the most frequent first: matched nodes merge, the others are added,
   which gives the host's wrapper tree.  A host with many skeletons is aligned in parts of
   bounded number, then the parts' wrappers again, level by level.
3. Each wrapper node is a slot.  Slot texts are counted over the pages of the host: texts that
   stand under nearly all different headlines are template (constant), the rest content.
4. A page is read through its host's wrapper: the content region is the slot that holds most
   varying text (an article or main element if the wrapper has one); menus, headers, footers,
   sidebars, notices, adverts, forms, comments, scripts and constant nodes inside it go.

Hosts may hold a third of all pages: only skeletons (counted) and slot texts (counted as
hashes, combined before the shuffle) meet by host, never pages.

Defined cases: null or empty html gives an empty text; pages whose url has no host (nulls
too) share one host ''; repeated rows are pages of their own and count once as evidence;
malformed markup is read as far as it goes; other columns are ignored; empty tables work.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.durable import durable
from tidemark.llm.tables import picked, table

# Elements of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg canvas".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
BOILERPLATE = frozenset("head nav header footer aside form button select textarea dialog menu fieldset label".split()) | RAW
REGIONS = ("article", "main")
PLAIN = frozenset("html body main".split())
# An end of one of these ends an open one of the same group (HTML's optional end tags).
CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table article main section div body html nav aside header footer form blockquote td th".split())
# Words of class, id and role that mark what is not the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright "
    "disqus footer form gdpr header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo "
    "promoted promotion related replies reply respond share sharing sidebar sidebars signup skip social sponsor sponsored subscribe "
    "subscription toolbar widget widgets".split()
)

#: A text is constant in a slot if it stands under so many different headlines, and that share.
MIN_HEADLINES, CONSTANT_SHARE = 5, 0.9
#: Skeletons that one task aligns.
ALIGN = 64
MAX_DEPTH = 200


@lru_cache(maxsize=1 << 14)
def role(tag: str, names: str) -> tuple[str, bool]:
    """An element's label, and whether it is never part of the article."""
    words = [w for w in re.split(r"[^a-z0-9]+", names.lower()) if w.isalpha()]
    return ".".join([tag, *words[:3]]), tag in BOILERPLATE or (tag not in PLAIN and not MARKS.isdisjoint(words))


class Node:
    __slots__ = ("tag", "label", "outside", "children")

    def __init__(self, tag: str, names: str = ""):
        self.tag = tag
        self.label, self.outside = role(tag, names)
        self.children: list[Node | str] = []


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        ends = CLOSES.get(tag)
        if tag in BLOCKS and tag not in CLOSES and tag != "br":
            ends = {"p"}
        if ends:
            for i in range(len(self.open) - 1, 0, -1):
                name = self.open[i].tag
                if name in ends:
                    del self.open[i:]
                    break
                if name in SCOPE and name not in ends:
                    break
        node = Node(tag, " ".join([v or "" for k, v in attrs if k in ("class", "id", "role")]) if attrs else "")
        self.open[-1].children.append(node)
        if tag not in VOID and len(self.open) < MAX_DEPTH:  # deeper ones are read as neighbours
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag and tag not in BLOCKS:
            self.open.pop()

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if self.open[i].tag in ("article", "main", "body") and tag not in ("body", "html"):
                return

    def updatepos(self, i, j):
        return j  # line numbers are not needed

    def handle_data(self, data):
        self.open[-1].children.append(data)


def dom(html: str | None) -> Node:
    p = _Tree()
    p.feed(html or "")
    p.close()
    return p.root


def skeleton(node: Node) -> list:
    """[label, [children]] of block elements, equal neighbours folded; inline elements pass through."""
    out: list = []
    for child in _blocks(node):
        s = skeleton(child)
        same = next((x for x in out if x[0] == s[0]), None)
        if same is None:
            out.append(s)
        else:
            same[1] = align(same, s)[1]
    return [node.label, out]


def _blocks(node: Node):
    for c in node.children:
        if isinstance(c, Node) and c.tag not in VOID:
            if c.tag in BLOCKS or c.outside:
                yield c
            else:
                yield from _blocks(c)


def matching(a: list, b: list) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: the largest number of matched nodes that keeps order, and the
    matched children."""
    if a[0] != b[0]:
        return 0, []
    m, n = len(a[1]), len(b[1])
    best = [[0] * (n + 1) for _ in range(m + 1)]
    w = [[matching(x, y)[0] if x[0] == y[0] else 0 for y in b[1]] for x in a[1]]
    for i in range(m):
        for j in range(n):
            best[i + 1][j + 1] = max(best[i + 1][j], best[i][j + 1], best[i][j] + w[i][j])
    pairs, i, j = [], m, n
    while i and j:
        if w[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + w[i - 1][j - 1]:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[m][n] + 1, pairs[::-1]


def align(a: list, b: list) -> list:
    """The wrapper of two trees with equal roots: matched nodes merge, others are put in place."""
    if a == b:
        return a
    _, pairs = matching(a, b)
    out, i, j = [], 0, 0
    for x, y in [*pairs, (len(a[1]), len(b[1]))]:
        out += a[1][i:x]
        out += [t for t in b[1][j:y] if all(t[0] != o[0] for o in (*a[1], *out))]
        if x < len(a[1]):
            out.append(align(a[1][x], b[1][y]))
        i, j = x + 1, y + 1
    return [a[0], out]


def slots(node: Node, path: str = ""):
    """(slot, node) for each block element: its labels from the root, one node of the wrapper."""
    for child in _blocks(node):
        at = f"{path}/{child.label}"
        yield at, child
        yield from slots(child, at)


def in_wrapper(slot: str, wrapper: list) -> bool:
    for label in slot.split("/")[1:]:
        wrapper = next((c for c in wrapper[1] if c[0] == label), None)
        if wrapper is None:
            return False
    return True


def _hash(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\n".join(parts).encode(), digest_size=8).digest(), "little", signed=True)


def own_blocks(node: Node, keep=lambda n: True) -> list[str]:
    """Texts of the blocks below ``node`` in page order, white space folded."""
    out: list[list[str]] = [[]]

    def walk(n: Node):
        for c in n.children:
            if isinstance(c, str):
                out[-1].append(c)
            elif c.outside or not keep(c):
                out.append([])
            elif c.tag in BLOCKS:
                out.append([])
                walk(c)
                out.append([])
            else:
                walk(c)

    walk(node)
    return [t for t in (" ".join("".join(x).split()) for x in out) if t]


def headline(root: Node) -> str:
    for wanted in ("h1", "title"):
        for _, n in slots(root):
            if n.tag == wanted:
                return " ".join("".join(c for c in n.children if isinstance(c, str)).split())
    return ""


def _leaf_text(node: Node) -> str:
    """Text of a block that has no blocks of its own."""
    if node.outside or any(True for _ in _blocks(node)):
        return ""
    return " ".join(own_blocks(node))


def region(root: Node, found: list[tuple[str, Node]], chosen: str | None) -> list[Node]:
    """The content nodes: article, else main, else the host's content slot, else everything."""
    for tag in REGIONS:
        nodes = [n for _, n in found if n.tag == tag and not n.outside]
        if nodes:
            inner = {id(x) for n in nodes for _, x in slots(n)}
            return [n for n in nodes if id(n) not in inner]
    nodes = [n for at, n in found if at == chosen]
    if nodes:
        inner = {id(x) for n in nodes for _, x in slots(n)}
        return [n for n in nodes if id(n) not in inner]
    return [root]


HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)"


FACT = "host string, shape string, slot string, head long, text long, n long"


def page_facts(batches):
    """The skeleton of each page (slot null) and the texts of its slots, from one parse."""
    for batch in batches:
        rows = []
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            root = dom(html)
            rows.append((host, json.dumps(skeleton(root), separators=(",", ":")), None, None, None, None))
            head = _hash(headline(root))
            seen = {(at, text) for at, n in slots(root) if (text := _leaf_text(n))}
            rows += [(host, None, at, head, _hash(at, text), len(text)) for at, text in seen]
        cols = list(zip(*rows, strict=True)) or [()] * 6
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in FACT.split(", ")])


def fold_shapes(group: pa.Table) -> pa.Table:
    """Align the skeletons of one part of a host, most frequent first."""
    rows = sorted(zip(group.column("n").to_pylist(), group.column("shape").to_pylist(), strict=True), key=lambda x: (-x[0], x[1]))
    wrapper = json.loads(rows[0][1])
    for _, shape in rows[1:]:
        wrapper = align(wrapper, json.loads(shape))
    host = group.column("host")[0].as_py()
    return pa.table({"host": [host], "shape": [json.dumps(wrapper, separators=(",", ":"))], "n": pa.array([sum(r[0] for r in rows)], pa.int64())})


def induce(facts: DataFrame) -> DataFrame:
    """(host, shape): each host's wrapper tree."""
    shapes = durable(facts.where("slot is null").groupBy("host", "shape").agg(F.count("*").alias("n")), "shapes")
    while True:
        count = shapes.groupBy("host").agg(F.count("*").alias("k"))
        most = count.agg(F.max("k")).first()[0] or 0
        if most <= 1:
            return shapes.select("host", "shape")
        parts = F.pmod(F.xxhash64("shape"), F.ceil(F.col("k") / F.lit(ALIGN)).cast("long"))
        dealt = shapes.join(count, "host").select("host", "shape", "n", parts.alias("part"))
        shapes = durable(dealt.groupBy("host", "part").applyInArrow(fold_shapes, "host string, shape string, n long"), "shapes")


def slot_facts(facts: DataFrame) -> DataFrame:
    """(host, constants, content): hashes of template texts, and the slot with most varying text."""
    facts = facts.where("slot is not null").select("host", "slot", "head", "text", "n").distinct()
    each = facts.groupBy("host", "slot", "text").agg(F.count_distinct("head").alias("k"), F.max("n").alias("n"))
    heads = facts.groupBy("host").agg(F.count_distinct("head").alias("heads"))
    judged = durable(each.join(heads, "host").withColumn("constant", (F.col("k") >= MIN_HEADLINES) & (F.col("k") >= CONSTANT_SHARE * F.col("heads"))), "slot-counts")
    # at most 1 / CONSTANT_SHARE texts of a slot can be constant, so lists are as long as a wrapper
    constants = judged.where("constant").groupBy("host").agg(F.sort_array(F.collect_set("text")).alias("constants"))
    # a slot's varying text counts for the block around it
    around = judged.where("not constant").groupBy("host", F.regexp_replace("slot", "/[^/]*$", "").alias("around")).agg(F.sum(F.col("n") * F.col("k")).alias("mass"))
    content = around.groupBy("host").agg(F.max_by("around", F.struct("mass", "around")).alias("content"))
    return heads.select("host").join(constants, "host", "left").join(content, "host", "left")


def _extract(batches):
    for batch in batches:
        texts = []
        for html, shape, constants, content in zip(*(batch.column(c).to_pylist() for c in ("html", "shape", "constants", "content")), strict=True):
            root = dom(html)
            found = list(slots(root))
            if content is not None and shape and not in_wrapper(content, json.loads(shape)):
                content = None
            gone: set[int] = set()
            if constants:
                fixed = set(constants)
                gone = {id(n) for at, n in found if (t := _leaf_text(n)) and _hash(at, t) in fixed}
            blocks = [b for r in region(root, found, content) for b in own_blocks(r, lambda n: id(n) not in gone)]
            texts.append(" ".join(blocks))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages`` (page_id, url, html)."""
    rows = picked(pages, page_id="long", url="string", html="string").withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1)))
    facts = durable(rows.select("host", "html").mapInArrow(page_facts, FACT), "page-facts")
    known = durable(induce(facts).join(slot_facts(facts), "host", "left"), "wrappers")
    joined = rows.join(known, "host", "left").select("page_id", "url", "html", "shape", "constants", "content")
    return joined.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op6_wrappers(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages"))


QUERIES = {"op6_wrappers": op6_wrappers}
ORACLES: dict[str, str] = {}
