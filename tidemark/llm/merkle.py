"""Merkle manifest of a dataset, with a witness for every row, built by appending.

Rows become leaf digests, and a source's leaves, by ascending id, a tree of 16 children a node;
the sources' roots, by name, are the leaves of a tree of their own.  A *witness* is what is
needed to get from a leaf to the root: for each level the digests left and right of it.

1. ``placed`` numbers the nodes of each tree without gathering one: a range partitioning over
   the whole sort key, the row's place in its partition, and one offset for each (tree, partition).
2. ``appended`` streams aligned blocks of 4096 nodes, in order.  ``Subtrees`` keeps only the
   open subtrees; the rows of an open subtree carry partial witnesses, and each time a run of
   siblings is complete, the witnesses of all its subtrees are extended by it.  A block is never
   more than 4096 rows, so a source with a third of all rows is as many blocks as it needs.
3. Block roots are the nodes of the next round, appended like the leaves before them, until
   every tree is one node; a round divides the nodes by 4096.  Upper witnesses then go down
   again, one row a block: ``settled`` appends the block a second time, the witness of its
   root comes first in the stream and completes those of its rows.

Text is hashed where it is read; only ids, digests and one witness a block are moved.

Defined cases: ids may repeat (rows go by id, then digest) or be null (before all others, and
never tampered with); null columns are ``-``; a null source is a tree before those of all
others; the only leaf of a source is its root, with no siblings; other columns are ignored; an
empty table has no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.durable import durable
from tidemark.llm.tables import picked, remainder, table

FAN = 16
#: Levels of a tree that one block covers, and its nodes.
BLOCK_LEVELS = 3
BLOCK = FAN**BLOCK_LEVELS
#: Which rows the audit tampers with: crc32 of the id divisible by this.
TAMPERED = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NODE = "tree string, at long, total long, digest string"
PATH = "path array<string>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(column: Column) -> Column:
    """``-`` for null, else the number of bytes, a colon, the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    return F.sha2(F.concat(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, digest, altered): altered is the digest of the tampered row, if it is one."""
    rows = picked(docs, doc_id="long", source="string", lang="string", n_chars="long", text="string")
    hit = remainder("doc_id", TAMPERED) == 0
    return rows.select(
        "doc_id", "source", leaf(F.col("text")).alias("digest"),
        F.when(hit, leaf(F.translate("text", UPPER, LOWER))).alias("altered"),
    )


def placed(nodes: DataFrame, *order: str) -> DataFrame:
    """Adds ``at`` (from 0) and ``total`` to the nodes of each ``tree`` (never null), by ``order``.

    The range covers the whole key, so a large tree spreads over many partitions."""
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = [F.col(c).asc_nulls_first() for c in ("tree", *order)]
    sorted_nodes = nodes.repartitionByRange(n, *key).sortWithinPartitions(*key)
    held = durable(sorted_nodes.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "placed")
    parts = held.groupBy("tree", "part").agg(F.min("place").alias("start"), F.count("*").alias("n"))
    before = Window.partitionBy("tree").orderBy("part")
    parts = parts.select(
        "tree", "part", "start",
        (F.sum("n").over(before) - F.col("n")).alias("offset"), F.sum("n").over(Window.partitionBy("tree")).alias("total"),
    )
    return held.join(parts, ["tree", "part"]).select(*nodes.columns, (F.col("place") - F.col("start") + F.col("offset")).alias("at"), "total")


def height(total: int) -> int:
    """Levels above ``total`` leaves."""
    levels = 0
    while total > 1:
        total, levels = -(-total // FAN), levels + 1
    return levels


class Subtrees:
    """The open subtrees of a block that is appended to, from its leaves up.

    Each is (digest, witnesses of its leaves); a witness is a list of left and right siblings
    by turns, and is extended when the run it is open in completes."""

    def __init__(self, levels: int):
        self.open: list[list[tuple[str, list[list[str]]]]] = [[] for _ in range(levels + 1)]

    def append(self, node: str) -> list[str]:
        """Appends a leaf; its witness grows with the leaves that follow."""
        witness: list[str] = []
        self._grow(0, node, [witness])
        return witness

    def _grow(self, level: int, node: str, witnesses: list[list[str]]) -> None:
        self.open[level].append((node, witnesses))
        if level + 1 < len(self.open) and len(self.open[level]) == FAN:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        nodes = [node for node, _ in run]
        for i, (_, witnesses) in enumerate(run):
            left, right = "".join(nodes[:i]), "".join(nodes[i + 1 :])
            for w in witnesses:
                w += (left, right)
        self._grow(level + 1, digest("".join(nodes)), [w for _, ws in run for w in ws])

    def close(self) -> str:
        """The root; the last run of each level is shorter."""
        for level in range(len(self.open) - 1):
            if self.open[level]:
                self._complete(level)
        return self.open[-1][0][0]


def folded(node: str, path: list[str]) -> str:
    """The root that a leaf and its witness give."""
    for left, right in zip(path[::2], path[1::2], strict=True):
        node = digest(left + node + right)
    return node


def _blocks(batches, columns: tuple[str, ...]) -> Iterator[list[tuple]]:
    """Rows of a sorted partition, one list for each (tree, block)."""
    key, held = None, []
    for batch in batches:
        names = ("tree", "at", *columns)
        for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            mine = (row[0], row[1] // BLOCK)
            if held and mine != key:
                yield held
                held = []
            key = mine
            held.append(row)
    if held:
        yield held


def appended(nodes: DataFrame) -> DataFrame:
    """The block roots of placed nodes, as placed nodes of the next round."""

    def run(batches):
        for rows in _blocks(batches, ("total", "digest")):
            tree, at, total = rows[0][:3]
            block = Subtrees(min(height(total), BLOCK_LEVELS))
            for row in rows:
                block.append(row[3])
            yield _rows([(tree, at // BLOCK, -(-total // BLOCK), block.close())], NODE)

    return in_blocks(nodes.select("tree", "at", "total", "digest")).mapInArrow(run, NODE)


def in_blocks(nodes: DataFrame, *then: str) -> DataFrame:
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return nodes.repartition(n, "tree", F.expr(f"at div {BLOCK}")).sortWithinPartitions("tree", F.expr(f"at div {BLOCK}"), *then, "at")


KINDS = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(f.split(" ") for f in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, KINDS[k]) for c, k in zip(columns, kinds, strict=True)], list(names))


def settled(nodes: DataFrame, above: DataFrame, extra: str, row_of) -> DataFrame:
    """Nodes with their whole witnesses: ``above`` has (tree, at, path) of their block roots.

    ``row_of(extra values, digest, path, block's path)`` makes what is returned besides
    (tree, at, total, digest), named by ``extra``."""
    names = [c for c in nodes.columns if c not in ("tree", "at", "total", "digest")]
    schema = f"{NODE}, {extra}"
    first = above.select("tree", (F.col("at") * BLOCK).alias("at"), F.lit(0).alias("kind"), "path")
    both = nodes.withColumn("kind", F.lit(1)).unionByName(first, allowMissingColumns=True)

    def run(batches):
        for rows in _blocks(batches, ("kind", "total", "digest", "path", *names)):
            upper, rows = rows[0][5], rows[1:]
            block = Subtrees(min(height(rows[0][3]), BLOCK_LEVELS))
            paths = [block.append(row[4]) for row in rows]
            block.close()
            yield _rows([(r[0], r[1], r[3], r[4], *row_of(r[6:], r[4], p + upper)) for r, p in zip(rows, paths, strict=True)], schema)

    return in_blocks(both, "kind").mapInArrow(run, schema)


def witnesses(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(roots, block witnesses) of placed nodes: the root of each tree as (tree, digest), and
    (tree, at, path) of each of their blocks up to the root of its tree."""
    roots = durable(appended(nodes), "blocks")
    largest = roots.agg(F.max("total")).first()[0] or 0
    if largest <= 1:
        return roots.select("tree", "digest"), roots.select("tree", "at", F.array().cast("array<string>").alias("path"))
    tops, above = witnesses(roots)
    return tops, settled(roots, above, PATH, lambda _, node, path: (path,)).select("tree", "at", "path")


def manifest(docs: DataFrame) -> DataFrame:
    """Each document with its leaf, the roots, and whether the row as it would be after tampering
    still folds to the root: (doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified)."""
    rows = durable(leaves(docs), "leaves")
    # a tree's name: nulls first, and no name is null
    named = rows.withColumn("tree", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    base = durable(placed(named, "doc_id", "digest"), "base")
    subroots, above = witnesses(base)
    # the tree over the sources; its nodes are named by it too
    of_source = durable(
        placed(subroots.select(F.lit("all").alias("tree"), F.col("tree").alias("name"), "digest"), "name"), "subroots"
    )
    root, top = witnesses(of_source)
    paths = settled(of_source, top, "name string, path array<string>", lambda more, node, path: (more[0], path))
    # one row a source, then one a block
    ends = durable(
        paths.join(root.select("tree", F.col("digest").alias("root")), "tree").select(
            F.col("name").alias("tree"), F.col("digest").alias("subroot"), "root", F.col("path").alias("top")
        ),
        "ends",
    )
    # a block's path is its own and its source's; the two ends come as its last entries
    upper = above.join(ends, "tree").select("tree", "at", F.concat("path", "top", F.array("subroot", "root")).alias("path"))

    def finish(more, node, path):
        *path, subroot, root = path
        source, doc_id, altered = more
        again = folded(altered or node, path)
        return doc_id, source, subroot, root, digest("".join(path)), again, again == root

    out = settled(
        base.select("tree", "at", "total", "digest", "source", "doc_id", "altered"), upper,
        "doc_id long, source string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean", finish,
    )
    return out.select("doc_id", "source", F.col("digest").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_merkle(spark, sf_dir):
    return manifest(table(spark, sf_dir, "documents")).drop("source")


def _sql(source_levels: int, top_levels: int) -> str:
    """The tree level by level; a level above a tree's root changes nothing."""

    def level(nodes: str, i: int) -> str:
        """Runs of level i, and the nodes above them."""
        return f"""
{nodes}_r{i} as (select t, k // {FAN} as k, list(d order by k) as ds, max(n) as n from {nodes}_{i} group by t, k // {FAN}),
{nodes}_{i + 1} as (select t, k, case when n = 1 then ds[1] else sha256(array_to_string(ds, '')) end as d,
  (n + {FAN - 1}) // {FAN} as n from {nodes}_r{i})"""

    def climb(states: str, nodes: str, i: int) -> str:
        """Proof and folded digest of each document after level i."""
        pos = f"(s.k % {FAN})"
        return f"""
{states}_{i + 1} as (select s.rid, s.t, r.k,
  proof || case when r.n = 1 then '' else array_to_string(ds[1:{pos}] || ds[{pos} + 2:], '') end as proof,
  case when r.n = 1 then s.d else sha256(array_to_string(ds[1:{pos}], '') || s.d || array_to_string(ds[{pos} + 2:], '')) end as d
  from {states}_{i} s join {nodes}_r{i} r on s.t = r.t and s.k // {FAN} = r.k)"""

    def encoded(c: str) -> str:
        return f"coalesce(octet_length(encode({c}::varchar))::varchar || ':' || {c}::varchar, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(encoded(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    low = f"translate(text, '{UPPER}', '{LOWER}')"
    parts = [
        """crc as (select list(v order by i) as tab from (select i, list_reduce(list_prepend(i, range(8)),
  lambda c, j: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) as v from range(256) r(i)))""",
        f"""leafs as (select row_number() over () as rid, doc_id, coalesce('s' || source, '') as t, {leaf('text')} as leaf,
  case when xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''),
    lambda x: ascii(x)::bigint)), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c // 256)), 4294967295) % {TAMPERED} = 0
    then {leaf(low)} else {leaf('text')} end as changed from documents, crc)""",
        """src_all as (select *, row_number() over (partition by t order by doc_id nulls first, leaf) - 1 as k,
  count(*) over (partition by t) as n from leafs)""",
        "src_0 as (select t, k, leaf as d, n from src_all)",
        "doc_0 as (select rid, t, k, '' as proof, changed as d from src_all)",
        *[x for i in range(source_levels) for x in (level("src", i), climb("doc", "src", i))],
        f"""subs as (select t as name, d, row_number() over (order by t) - 1 as k, count(*) over () as n from src_{source_levels})""",
        "top_0 as (select 1 as t, k, d, n from subs)",
        f"""end_0 as (select rid, 1 as t, subs.k, proof, s.d from doc_{source_levels} s join subs on s.t = subs.name)""",
        *[x for i in range(top_levels) for x in (level("top", i), climb("end", "top", i))],
    ]
    return (
        "with "
        + ",\n".join(parts)
        + f"""
select doc_id, leaf, subs.d as subroot, top_{top_levels}.d as root, sha256(e.proof) as proof_sha256, e.d as folded_root,
  e.d = top_{top_levels}.d as verified
from leafs join end_{top_levels} e using (rid) join subs on leafs.t = subs.name cross join top_{top_levels}"""
    )


QUERIES = {"op13_merkle": op13_merkle}

#: 16^6 leaves a source and 16^4 sources.
ORACLES = {"op13_merkle": _sql(6, 4)}
