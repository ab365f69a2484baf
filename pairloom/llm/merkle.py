"""Merkle manifest of a document table with tampering by path copying (operator 12).

Every document is a leaf; the leaves of a source, in the order of their ids, make a tree with runs of ``FAN`` children, and the roots of all
sources make one more tree of the same kind. All digests are SHA-256 in lowercase hex, over concatenated digests in hex.

How it runs:

* Leaves (and changed leaves) are hashed once and written. Range partitioning by (source, id) and the counts of each (partition, source) give
  every leaf its place in its source without a sort in one task.
* Places are cut into aligned blocks of ``SPAN = FAN ** 3`` leaves. A block is built by one task as a subtree, its root is a node of the next level,
  and the same step runs on these nodes until each source has one root, then on the roots of the sources. A source of any size is many blocks.
* The tree is persistent: a changed leaf makes a version of its block that copies the ancestors of that leaf and shares every other node. The copied
  block root goes on through the nodes above the block: at each upper level the version is one new node between the shared ones. The root of the
  version is the folded root of a tampered row; that of any other row is folded from its leaf and siblings.

Order and edge cases: sources sort bytewise, null first (null is a source of its own). Null ids come first and are never tampered with. Rows with equal
source and id sort by their leaf, so equal rows are neighbours; each keeps a leaf and a proof of its own. A tampered text without A-Z, or a null or
empty one, stays as it is and verifies. Texts of any length are hashed whole. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_folder, table
from .line_templates import kept_table

FAN, HEIGHT = 16, 3
SPAN = FAN ** HEIGHT
TAMPER = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STEP = "array<struct<before:string,after:string>>"


# ---------- leaves and their places ----------

def field(x: Column) -> Column:
    s = x.cast("string")
    return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_rows(docs: DataFrame) -> DataFrame:
    """``g, doc_id, leaf, changed``: ``g`` names the source and sorts like it, ``changed`` is null where nothing is tampered with."""
    def digest(text: Column) -> Column:
        return F.unhex(F.sha2(F.concat(*[field(F.col(c)) for c in FIELDS[:-1]], field(text)).cast("binary"), 256))

    source = F.col("source").cast("string")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER == 0
    return docs.select(F.when(source.isNull(), "-").otherwise(F.concat(F.lit("="), source)).alias("g"), F.col("doc_id").cast("long").alias("doc_id"),
                       digest(F.col("text")).alias("leaf"), F.when(hit, digest(F.translate("text", UPPER, LOWER))).alias("changed"))


def placed(rows: DataFrame, order: list[str], folder: str, name: str) -> DataFrame:
    """Adds ``pos`` (from 0) and ``total`` of each row in its ``g``, in the given order; rows alike in all of it stand in any order."""
    keys = ["g", *order, "tie"]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranked = kept_table(dealt.drop("tie").withColumn("row", F.monotonically_increasing_id()), folder, f"{name}-ranked")
    part = F.shiftright("row", 33)
    runs = ranked.groupBy("g", part.alias("part")).agg(F.min("row").alias("first"), F.count("*").alias("n"))
    per_source = Window.partitionBy("g")
    ahead = F.coalesce(F.sum("n").over(per_source.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("g", "part", (ahead - F.col("first")).alias("shift"), F.sum("n").over(per_source).alias("total"))
    return ranked.withColumn("part", part).join(runs, ["g", "part"]).withColumn("pos", F.col("row") + F.col("shift")).drop("row", "part", "shift")


# ---------- one aligned block ----------

def node(children: list[bytes]) -> bytes:
    return sha256(b"".join(children)).hexdigest().encode()


class Block:
    """The subtree over at most ``SPAN`` nodes; ``alone``: no other block belongs to the source, so it ends at its first single node."""

    def __init__(self, leaves: list[bytes], alone: bool):
        self.levels = [leaves]
        while len(self.levels[-1]) > 1 or not alone and len(self.levels) <= HEIGHT:
            below = self.levels[-1]
            self.levels.append([node(below[i:i + FAN]) for i in range(0, len(below), FAN)])

    @property
    def root(self) -> bytes:
        return self.levels[-1][0]

    def path(self, at: int) -> list[tuple[bytes, bytes]]:
        """The siblings before and after the node at each level below the root."""
        out = []
        for level in self.levels[:-1]:
            first = at - at % FAN
            out.append((b"".join(level[first:at]), b"".join(level[at + 1:first + FAN])))
            at //= FAN
        return out


class Node:
    """One node of a persistent tree: never changed after it is made, so versions of a tree can share it."""

    __slots__ = ("digest", "children")

    def __init__(self, digest: bytes, children: tuple["Node", ...] = ()):
        self.digest, self.children = digest, children


def parent(children: tuple[Node, ...]) -> Node:
    return Node(node([c.digest for c in children]), children)


def tree_of(block: Block) -> Node:
    """The nodes of a block's subtree."""
    level = [Node(x) for x in block.levels[0]]
    for digests in block.levels[1:]:
        level = [Node(digest, tuple(level[i * FAN:(i + 1) * FAN])) for i, digest in enumerate(digests)]
    return level[0]


def copy_path(root: Node, at: int, height: int, leaf: Node) -> Node:
    """The root of the version with ``leaf`` at place ``at``: the ancestors of the leaf are copied and hashed, all other nodes are shared."""
    if not height:
        return leaf
    i = at // FAN ** (height - 1)
    new = copy_path(root.children[i], at - i * FAN ** (height - 1), height - 1, leaf)
    return parent((*root.children[:i], new, *root.children[i + 1:]))


def path_tree(rest: list[tuple[bytes, bytes]], below: Node) -> tuple[Node, list[int]]:
    """The nodes above the block root ``below``, whose siblings are ``rest``, and its place among the children at each level, root first."""
    places = []
    for before, after in rest:
        split = lambda raw: tuple(Node(raw[i:i + 64]) for i in range(0, len(raw), 64))
        places.append(len(before) // 64)
        below = parent((*split(before), below, *split(after)))
    return below, places[::-1]


def copy_above(root: Node, places: list[int], new: Node) -> Node:
    """``copy_path`` through the nodes above a block: ``new`` is the version of the block's root."""
    if not places:
        return new
    i = places[0]
    return parent((*root.children[:i], copy_above(root.children[i], places[1:], new), *root.children[i + 1:]))


def folded_root(leaf: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root as a verifier recomputes it from a leaf and its siblings."""
    for before, after in path:
        leaf = sha256(before + leaf + after).hexdigest().encode()
    return leaf


def hexes(raw: pa.Array) -> list[bytes]:
    return [x.as_py().hex().encode() for x in raw]


def blocks_of(nodes: DataFrame, payload: str) -> DataFrame:
    """One row per aligned block: ``g, block, total, leaves, root`` and the payload columns as lists. ``nodes``: ``g, pos, total, leaf`` and payload."""
    extra = [x.split() for x in payload.split(", ")] if payload else []
    names = ["g", "block", "total", "leaves", "root", *[n for n, _ in extra]]

    def finish(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        total = t.column("total")[0].as_py()
        leaves = t.column("leaf").to_pylist()
        tree = Block([x.hex().encode() for x in leaves], total <= SPAN)
        lists = [pa.array([t.column(n).to_pylist()], pa.list_(t.schema.field(n).type)) for n, _ in extra]
        return pa.RecordBatch.from_arrays([t.column("g").slice(0, 1).combine_chunks(), pa.array([t.column("pos")[0].as_py() // SPAN]), pa.array([total]),
                                           pa.array([b"".join(leaves)], pa.binary()), pa.array([tree.root.decode()]), *lists], names=names)

    def run(batches):
        waiting: list[pa.RecordBatch] = []
        for b in batches:
            start = np.flatnonzero(b.column(1).to_numpy() % SPAN == 0).tolist()  # every block has the row of its first place
            for x, y in zip([0, *start], [*start, b.num_rows]):
                if x in start and waiting:
                    yield finish(waiting)
                    waiting = []
                if y > x:
                    waiting.append(b.slice(x, y - x))
        if waiting:
            yield finish(waiting)

    rows = nodes.select("g", "pos", "total", "leaf", *[n for n, _ in extra]).withColumn("block", F.expr(f"pos div {SPAN}"))
    dealt = rows.repartition("g", "block").sortWithinPartitions("g", "block", "pos").drop("block")
    kinds = "".join(f", {n} array<{t}>" for n, t in extra)
    return dealt.mapInArrow(run, f"g string, block long, total long, leaves binary, root string{kinds}")


# ---------- upper levels ----------

def upper_paths(nodes: DataFrame, folder: str, name: str) -> tuple[DataFrame, DataFrame]:
    """``g, pos, path`` of every node up to the root of its ``g``, and ``g, root``. Each call is one level of blocks."""
    blocks = kept_table(blocks_of(nodes, ""), folder, f"{name}-blocks")

    def own(batches):
        for b in batches:
            for r in b.to_pylist():
                raw = r["leaves"]
                tree = Block([raw[i:i + 32].hex().encode() for i in range(0, len(raw), 32)], r["total"] <= SPAN)
                n = len(raw) // 32
                path = [[{"before": x.decode(), "after": y.decode()} for x, y in tree.path(i)] for i in range(n)]
                kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
                yield pa.RecordBatch.from_arrays([pa.array([r["g"]] * n, pa.string()), pa.array([r["block"]] * n, pa.int64()),
                                                  pa.array(np.arange(n) + r["block"] * SPAN), pa.array(path, kind)], names=["g", "block", "pos", "path"])

    paths = blocks.mapInArrow(own, f"g string, block long, pos long, path {STEP}")
    above, roots = above_blocks(blocks, folder, name)
    if above is not None:
        paths = paths.join(above, ["g", "block"], "left").withColumn("path", F.when(F.col("above").isNull(), F.col("path")).otherwise(F.concat("path", "above")))
    return paths.select("g", "pos", "path"), roots


def above_blocks(blocks: DataFrame, folder: str, name: str) -> tuple[DataFrame | None, DataFrame]:
    """``g, block, above`` for the blocks that are not alone in their ``g`` (None: all are), and ``g, root`` for all."""
    roots = blocks.where(F.col("total") <= SPAN).select("g", "root")
    many = blocks.where(F.col("total") > SPAN)
    if many.isEmpty():
        return None, roots
    nodes = many.select("g", F.col("block").alias("pos"), F.ceil(F.col("total") / SPAN).alias("total"), F.unhex("root").alias("leaf"))
    paths, tops = upper_paths(nodes, folder, f"{name}-up")
    return paths.select("g", F.col("pos").alias("block"), F.col("path").alias("above")), roots.unionByName(tops)


def manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row of ``docs`` (``doc_id, source, lang, n_chars, text``)."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "merkle")
    leaves = kept_table(leaf_rows(docs), folder, "leaves")
    blocks = kept_table(blocks_of(placed(leaves, ["doc_id", "leaf"], folder, "leaf"), "doc_id bigint, changed binary"), folder, "blocks")
    above, roots = above_blocks(blocks, folder, "leaf")
    roots = kept_table(roots, folder, "roots")
    sources = placed(roots.select(F.lit("").alias("g"), F.col("g").alias("source"), F.unhex("root").alias("leaf")), ["source"], folder, "source")
    top, root = upper_paths(sources.select("g", "pos", "total", "leaf"), folder, "source")
    named = sources.select("pos", F.col("source").alias("g"), F.lower(F.hex("leaf")).alias("subroot")).join(top.select("pos", "path"), "pos").drop("pos")
    steps = blocks.select("g", "block").join(named, "g")  # small rows: a hot source has one for each of its blocks
    if above is not None:
        steps = steps.join(above, ["g", "block"], "left").withColumn("path", F.when(F.col("above").isNull(), F.col("path")).otherwise(F.concat("above", "path")))
    first = root.first()
    whole = first["root"] if first else ""

    def emit(batches):
        for b in batches:
            for r in b.to_pylist():
                raw, n = r["leaves"], len(r["doc_id"])
                tree = Block([raw[i:i + 32].hex().encode() for i in range(0, len(raw), 32)], r["total"] <= SPAN)
                rest = [(s["before"].encode(), s["after"].encode()) for s in r["path"]]
                block, height = tree_of(tree), len(tree.levels) - 1
                upper, places = path_tree(rest, block)
                proof, folded = [], []
                for i in range(n):
                    path = tree.path(i) + rest
                    proof.append(sha256(b"".join([x + y for x, y in path])).hexdigest())
                    changed = r["changed"][i]
                    if changed is None:
                        folded.append(folded_root(tree.levels[0][i], path).decode())
                    else:
                        version = copy_path(block, i, height, Node(changed.hex().encode()))
                        folded.append(copy_above(upper, places, version).digest.decode())
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_id"], pa.int64()), pa.array([x.decode() for x in tree.levels[0]], pa.string()), pa.array([r["subroot"]] * n, pa.string()),
                                                  pa.array([whole] * n, pa.string()), pa.array(proof, pa.string()), pa.array(folded, pa.string())],
                                                 names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"])

    rows = blocks.drop("root").join(steps.select("g", "block", "subroot", "path"), ["g", "block"])
    out = rows.mapInArrow(emit, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle(spark, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"
_HEAD = " || ".join(_FIELD.format(c) for c in FIELDS[:-1])
_LOWERED = f"translate(text, '{UPPER}', '{LOWER}')"
_SIBLINGS = """SELECT {g}, lvl, pos,
    coalesce(string_agg(h, '') OVER (PARTITION BY {g}, lvl, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS ahead,
    coalesce(string_agg(h, '') OVER (PARTITION BY {g}, lvl, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS behind
  FROM {tree}"""
OP12_SQL = f"""
WITH RECURSIVE
codes AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
  FROM range(256) r(i))),
checked AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % {TAMPER} = 0 AS hit FROM documents, codes),
leaves AS (SELECT doc_id, source, sha256({_HEAD} || {_FIELD.format('text')}) AS leaf,
    CASE WHEN coalesce(hit, false) THEN sha256({_HEAD} || {_FIELD.format(_LOWERED)}) ELSE sha256({_HEAD} || {_FIELD.format('text')}) END AS changed FROM checked),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaves),
tree AS (SELECT source, 0 AS lvl, pos, n, leaf AS h FROM ranked
  UNION ALL SELECT source, lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY source, lvl, n, pos // 16),
siblings AS ({_SIBLINGS.format(g='source', tree='tree')}),
walk AS (SELECT doc_id, leaf, source, 0 AS lvl, pos, n, changed AS h, '' AS proof FROM ranked
  UNION ALL SELECT w.doc_id, w.leaf, w.source, w.lvl + 1, w.pos // 16, (w.n + 15) // 16, sha256(s.ahead || w.h || s.behind), w.proof || s.ahead || s.behind
  FROM walk w JOIN siblings s ON s.source IS NOT DISTINCT FROM w.source AND s.lvl = w.lvl AND s.pos = w.pos WHERE w.n > 1),
subroots AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
crown AS (SELECT 0 AS g, 0 AS lvl, pos, n, h FROM subroots
  UNION ALL SELECT g, lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM crown WHERE n > 1 GROUP BY g, lvl, n, pos // 16),
crown_siblings AS ({_SIBLINGS.format(g='g', tree='crown')}),
climb AS (SELECT w.doc_id, w.leaf, r.h AS subroot, 0 AS lvl, r.pos, r.n, w.h, w.proof FROM walk w JOIN subroots r ON r.source IS NOT DISTINCT FROM w.source WHERE w.n = 1
  UNION ALL SELECT w.doc_id, w.leaf, w.subroot, w.lvl + 1, w.pos // 16, (w.n + 15) // 16, sha256(s.ahead || w.h || s.behind), w.proof || s.ahead || s.behind
  FROM climb w JOIN crown_siblings s ON s.lvl = w.lvl AND s.pos = w.pos WHERE w.n > 1)
SELECT c.doc_id, c.leaf, c.subroot, k.h AS root, sha256(c.proof) AS proof_sha256, c.h AS folded_root, c.h = k.h AS verified
FROM climb c, (SELECT h FROM crown WHERE n = 1) k WHERE c.n = 1
"""
