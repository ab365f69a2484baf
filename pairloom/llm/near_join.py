"""N-gram Jaccard join by an LSH forest (operator 4): all pairs of documents with word 5-gram Jaccard similarity of 0.8 or more.

1. Each text becomes its set of five-word shingles (64-bit hashes; words are white-space runs, ASCII letters in lower case; a shorter text is
   one shingle). Texts with equal sets are one node, so copies are never compared.
2. A node's MinHash signature is a label in each of ``TREES`` prefix tries. Nodes that share a prefix in some trie are candidates. The
   matched prefix is shortened from the full label until the chance that a pair at the threshold shares
   one, ``1 - (1 - t^depth)^trees``, reaches ``RECALL``.
3. Inside a trie node the members, sorted by their labels, are compared by whole signatures: each leader links to every member
   that may still be similar to a member close to it, so that similar members stay connected. Only a spanning forest leaves the task.
4. Connected groups of candidates are verified exactly: every group's shingle sets meet once, in blocks, and all similarities of a
   block pair are counted as one matrix product. Only link counts and a spanning forest leave the task.
5. Classes are the connected components of the exact links.

A trie node or group with many members is split into blocks, and block pairs are the unit of work; no pairs are emitted as rows.

A text without words has an empty set; such texts are copies of each other and of nothing else. Null text counts as empty. Rows with
a null id take part; a class whose members all lack ids has a null id. Repeated rows are documents of their own.
Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, settle, shared_folder, slices, table, utf8_buffer, word_hashes, word_spans
from .kn_quality import release
from .line_templates import kept_table

WORDS, THRESHOLD = 5, 0.8
TREES, LABEL, RECALL = 32, 8, 0.9999
CHUNK_BYTES = 1 << 20
BUCKET_BLOCK, GROUP_BLOCK = 2048, 384
HOME, VISIT = 0.9, 0.56
KEY_BITS = 1 << 23


def depth_for(threshold: float, trees: int, label: int, recall: float) -> int:
    """The longest prefix, from the whole label down, that finds a pair at the threshold with the wanted chance."""
    depth = label
    while depth > 1 and 1 - (1 - threshold ** depth) ** trees < recall:
        depth -= 1
    return depth


# ---------- shingles and signatures ----------

def shingles(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted inside it, and each text's first place (``n + 1`` places)."""
    raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    start, stop, first = word_spans(raw, offsets)
    words = word_hashes(raw, start, stop)
    n = np.diff(first)
    many = np.maximum(n - WORDS + 1, (n > 0).astype(np.int64))
    place = np.concatenate([[0], np.cumsum(many)])
    owner = np.repeat(np.arange(len(n)), many)
    at = np.arange(place[-1]) - place[owner] + first[owner]
    h = np.zeros(len(at), np.uint64)
    end = first[1:][owner]
    padded = np.concatenate([words, np.zeros(WORDS, np.uint64)])
    for k in range(WORDS):
        part = np.where(at + k < end, padded[at + k], np.uint64(0))
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + part + np.uint64(k + 1))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]) if len(h) else np.zeros(0, bool)
    h, owner = h[fresh], owner[fresh]
    return h, np.searchsorted(owner, np.arange(len(n) + 1))


def set_names(h: np.ndarray, first: np.ndarray) -> list[bytes]:
    """128-bit name of each set: two sums of mixed members, with the size."""
    size = np.diff(first)
    out = np.zeros((len(size), 2), dtype=">u8")
    full = size > 0
    if full.any():
        at = first[:-1][full]
        out[full, 0] = mix64(np.add.reduceat(mix64(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at) + size[full].astype(np.uint64))
        out[full, 1] = mix64(np.add.reduceat(mix64(h * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)), at))
    data = out.tobytes()
    return [data[i:i + 16] for i in range(0, len(data), 16)]


def signatures(h: np.ndarray, first: np.ndarray, values: int) -> np.ndarray:
    """One byte of each of ``values`` MinHash values, per set (zero for empty sets)."""
    rng = np.random.default_rng(8)
    a = rng.integers(0, 1 << 63, size=values, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    size = np.diff(first)
    full = size > 0
    out = np.zeros((len(size), values), dtype=np.uint8)
    if full.any():
        at = first[:-1][full]
        for j in range(values):
            x = h * a[j]
            x ^= x >> np.uint64(32)  # high bits decide the order, and they depend on all bits of the product
            least = np.minimum.reduceat(x * a[values - 1 - j], at)
            out[full, j] = (mix64(least) & np.uint64(255)).astype(np.uint8)
    return out


def sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``id, text_hash, node, size, label``: per document its set's name and size and the signature bytes."""
    values = TREES * LABEL

    def run(batches):
        for b in batches:
            raw, off = utf8_buffer(b.column(2))
            for i, j in slices(off, CHUNK_BYTES):
                h, first = shingles(raw[off[i]:off[j]], off[i:j + 1] - off[i])
                label = signatures(h, first, values).tobytes()
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array(set_names(h, first), pa.binary()), pa.array(np.diff(first).astype(np.int64)),
                    pa.array([label[x:x + values] for x in range(0, len(label), values)], pa.binary())],
                    names=["id", "text_hash", "node", "size", "label"])

    t = F.col(text).cast("string")
    rows = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(t).alias("text_hash"), t.alias("text"))
    return rows.mapInArrow(run, "id long, text_hash long, node binary, size long, label binary")


# ---------- groups of sorted rows ----------

def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows with equal first column (sorted) as one table each."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        g = b.column(0).to_numpy()
        edge = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]])
        if rest and rest[0].column(0)[0].as_py() != g[0]:
            yield pa.Table.from_batches(rest)
            rest = []
        for x, y in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if x and rest:
                yield pa.Table.from_batches(rest)
                rest = []
            rest.append(b.slice(x, y - x))
    if rest:
        yield pa.Table.from_batches(rest)


class Forest:
    """Union-find over a group's rows that keeps the joining edges."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.edges: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.edges.append((a, b))


def blocked_groups(members: DataFrame, group: str, block: int) -> DataFrame:
    """Adds ``g`` (unit of work), ``side`` and ``cross``: a group above ``block`` rows is cut and its block pairs are the units."""
    count = members.groupBy(group).agg(F.ceil(F.count("*") / block).alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    rows = members.join(count, group).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    return rows.withColumn("g", F.xxhash64(group, low, high)).withColumn("cross", low != high).withColumn("side", (F.col("own") != low).cast("int")).drop("blocks", "own", "other", group)


# ---------- candidates ----------

def candidate_edges(nodes: DataFrame, depth: int) -> DataFrame:
    """``a, b``: a forest that connects all nodes that may be similar."""
    tries = F.explode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.xxhash64(t, F.substring("label", t * LABEL + 1, F.lit(depth)))))
    member = nodes.where(F.col("size") > 0).select("node", tries.alias("bucket"))
    crowded = member.groupBy("bucket").count().where(F.col("count") > 1).select("bucket")
    member = member.join(crowded, "bucket", "left_semi")
    rows = blocked_groups(member.join(nodes.select("node", "label"), "node"), "bucket", BUCKET_BLOCK).select("g", "label", "node")

    def run(batches):
        out: list[tuple[bytes, bytes]] = []
        for t in runs(batches):
            names = t.column("node").to_pylist()
            label = np.frombuffer(b"".join(t.column("label").to_pylist()), dtype=np.uint8).reshape(len(names), -1)
            forest, free = Forest(len(names)), np.ones(len(names), dtype=bool)
            for i in range(len(names)):
                if free[i]:
                    same = (label == label[i]).mean(axis=1)
                    free &= same < HOME
                    for j in np.flatnonzero(same >= VISIT).tolist():
                        forest.join(i, j)
            out += [(names[a], names[b]) for a, b in forest.edges]
            if len(out) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], names=["a", "b"])
                out = []
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], names=["a", "b"])

    found = rows.repartition("g").sortWithinPartitions("g", "label", "node").mapInArrow(run, "a binary, b binary")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """``node, component`` for every node with an edge: each node moves to its smallest neighbour until no edge is left."""
    edges = kept_table(edges, folder, f"{name}-edges-0")
    place, step = None, 0
    while not edges.isEmpty():
        step += 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        move = kept_table(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")).withColumnRenamed("a", "node"), folder, f"{name}-move-{step}")
        if place is None:
            place = move.withColumnRenamed("to", "component")
        else:
            hop = move.select(F.col("node").alias("component"), "to")
            place = place.join(hop, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        place = kept_table(place, folder, f"{name}-place-{step}")
        left = move.select(F.col("node").alias("a"), F.col("to").alias("x"))
        right = move.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = edges.join(left, "a").join(right, "b").where(F.col("x") != F.col("y"))
        edges = kept_table(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), folder, f"{name}-edges-{step}")
    if place is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return place


# ---------- exact verification ----------

def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, as a matrix product over the shingles that stand in several sets."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = seen[column] > 1
    owner, column = owner[keep], column[keep]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((n, n), dtype=np.float32)
    columns = int(column[-1]) + 1 if len(column) else 0
    width = max(1, min(columns, max(256, (1 << 22) // max(n, 1))))
    for x in range(0, columns, width):
        a, b = np.searchsorted(column, [x, x + width])
        m = np.zeros((n, width), dtype=np.float32)
        m[owner[a:b], column[a:b] - x] = 1
        total += m @ m.T
    return total


def verified(members: DataFrame) -> DataFrame:
    """``a, b, links``: rows with ``b`` are forest edges between similar nodes; rows without are link counts of ``a``.

    ``members``: ``component, node, docs, text``."""
    rows = blocked_groups(members, "component", GROUP_BLOCK).select("g", "cross", "side", "node", "docs", "text")

    def run(batches):
        out: list[tuple] = []
        for t in runs(batches):
            names, docs = t.column("node").to_pylist(), t.column("docs").to_numpy()
            if len(names) > 1:
                sets = []
                for b in t.to_batches():
                    raw, off = utf8_buffer(b.column(5))
                    for i, j in slices(off, CHUNK_BYTES):
                        h, first = shingles(raw[off[i]:off[j]], off[i:j + 1] - off[i])
                        sets += [h[x:y] for x, y in zip(first[:-1].tolist(), first[1:].tolist())]
                size = np.array([len(s) for s in sets], dtype=np.float64)
                both = overlaps(sets).astype(np.float64)
                close = both >= THRESHOLD * (size[:, None] + size[None, :] - both) - 1e-9
                np.fill_diagonal(close, False)
                if t.column("cross")[0].as_py():
                    side = t.column("side").to_numpy()
                    close &= side[:, None] != side[None, :]
                links = close @ docs
                forest = Forest(len(names))
                for i in range(len(names)):
                    near = np.flatnonzero(close[i, i + 1:]) + i + 1
                    for j in near.tolist():
                        forest.join(i, j)
                out += [(names[a], names[b], 0) for a, b in forest.edges]
                out += [(names[i], None, int(links[i])) for i in np.flatnonzero(links).tolist()]
            if len(out) > 50_000:
                yield batch(out)
                out = []
        yield batch(out)

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.binary(), pa.binary(), pa.int64()))], names=["a", "b", "links"])

    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(run, "a binary, b binary, links long")


# ---------- texts that stay where they are ----------

def maybe_among(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` with ``__maybe``, false only where their ``id, text_hash`` are surely not among those of ``keys``.

    The keys are bits in at most ``KEY_BITS / 64`` longs, so what is broadcast is bounded at any size of the tables. Where keys share a
    bit, rows are marked that are not among them: the join that follows decides."""
    at = F.pmod(F.xxhash64("id", "text_hash"), F.lit(KEY_BITS))
    page, bit = F.shiftright(at, 6), F.pmod(at, F.lit(64)).cast("int")
    pages = keys.select(page.alias("__page"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("__bit")).groupBy("__page").agg(F.bit_or("__bit").alias("__bits"))
    return rows.withColumn("__page", page).join(F.broadcast(pages), "__page", "left").withColumn("__maybe", F.coalesce(F.getbit("__bits", bit) == 1, F.lit(False))).drop("__page", "__bits")


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, text_hash, class_id, n_links`` for every row: the smallest id of its class and the number of its similar documents."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "near")
    rows = kept_table(sketches(docs, key, text), folder, "sketches")
    nodes = kept_table(rows.groupBy("node").agg(
        F.count("*").alias("docs"), F.min("id").alias("least"), F.min(F.struct("id", "text_hash")).alias("one"), F.first("size").alias("size"), F.first("label").alias("label")), folder, "nodes")
    near = components(candidate_edges(nodes, depth_for(THRESHOLD, TREES, LABEL, RECALL)), folder, "near")
    release(spark)
    info = kept_table(near.join(nodes.select("node", "docs", "one.id", "one.text_hash"), "node"), folder, "members")
    t = F.col(text).cast("string")
    texts = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(t).alias("text_hash"), t.alias("text"))
    texts = maybe_among(texts, info).where("__maybe").select(F.col("id").alias("doc"), F.col("text_hash").alias("hash"), "text")  # only members' texts move
    # one plan at every size: texts meet their members in a shuffle, also where the members would be small enough to broadcast
    member = info.join(texts.hint("merge"), F.col("id").eqNullSafe(F.col("doc")) & (F.col("text_hash") == F.col("hash"))).dropDuplicates(["node"]).select("component", "node", "docs", "text")
    found = kept_table(verified(member), folder, "links")
    release(spark)
    links = found.where(F.col("b").isNull()).groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    exact = components(found.where(F.col("b").isNotNull()).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), folder, "exact")
    least = exact.join(nodes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("class_id"))
    linked = kept_table(exact.join(least, "component").join(links, "node", "left").select("node", "class_id", "links"), folder, "classes")
    named = nodes.select("node", "docs", "least").join(linked, "node", "left").select(
        "node", F.when(F.col("links").isNull(), F.col("least")).otherwise(F.col("class_id")).alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("docs") - 1).alias("n_links"))
    return rows.select("id", "text_hash", "node").join(named, "node").select("id", "text_hash", "class_id", "n_links")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each class the row with the smallest (id, text hash) stays, once."""
    found = settle(near_classes(docs, key, text))
    none = F.col("class_id").isNull()
    first = found.groupBy("class_id", F.when(none, F.col("text_hash")).alias("alone")).agg(F.min(F.struct("id", "text_hash")).alias("one"))
    stay = first.select("one.id", "one.text_hash")
    # rows that stay and have no copy are written from where they are; the others, and the few that share their bits, meet ``stay``
    counted = found.groupBy("id", "text_hash").agg(F.count("*").alias("n"))
    one = stay.select(F.col("id").alias("one_id"), F.col("text_hash").alias("one_hash"))
    same = F.col("id").eqNullSafe(F.col("one_id")) & (F.col("text_hash") == F.col("one_hash"))
    doubt = counted.join(one, same, "left").where((F.col("n") > 1) | F.col("one_hash").isNull())
    names = {c: f"__own_{i}" for i, c in enumerate(docs.columns)}
    own = docs.select(docs[key].cast("long").alias("id"), F.xxhash64(docs[text].cast("string")).alias("text_hash"), *[docs[c].alias(n) for c, n in names.items()])
    own = maybe_among(own, doubt)
    # the join and the removal of repeated rows go by the same columns without nulls, so that a text moves once
    by = [F.coalesce("id", F.lit(0)).alias("__id"), F.col("id").isNull().alias("__none"), F.col("text_hash").alias("__hash")]
    met = own.where("__maybe").select(*by, *names.values()).join(stay.select(*by), ["__id", "__none", "__hash"]).dropDuplicates(["__id", "__none", "__hash"])
    kept = own.where("NOT __maybe").select(*names.values()).unionByName(met.select(*names.values()))
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])


def op4_near_join(spark, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id", "n_links")
