"""Near-duplicates by bottom-k sketches (operator 13): documents whose sets of two-word shingles have Jaccard similarity of 0.8 or more.

1. A text becomes its set of distinct two-word shingles (64-bit hashes; words are runs without blanks and control breaks, A-Z in lower case; a shorter
   text is one shingle). Texts with equal sets are one node, so copies are never compared.
2. One hash function orders all shingles; a node keeps its ``K`` smallest values, the sketch. The inverted lists go by runs of ``RUN`` retained values that
   follow each other in this order. Similar sets share most of their smallest values, so they share such a run: with similarity 0.8 the chance that
   no run of three among 48 is shared is below 1e-7, and a set that fits its sketch always shares one (sets of four and five members, where a run of three can be
   missing, have lists of their own). A run is far rarer than a single value, so lists stay short where a common shingle stands in a third of all texts.
3. Each list proposes its members a leader: the member whose values stand in most sketches (of a family of edited copies that is the text they stem from).
   The proposals, one per member and list, are verified exactly, and linked nodes become one component.
4. Members of a list that are in several components after that meet again: all lists of one leader together, each member once. Members of different components whose
   set sizes allow it are compared by the estimate from the union of both sketches (the share of its ``K`` smallest values that both hold), and where that is not below
   ``LOWEST`` of ``K``, exactly by their whole sets. The chance that a pair at 0.8 has a lower estimate is below 1e-6. A spanning forest of these links closes the components.

No list is gathered in one task: leaders come from aggregates, and a leader's many members are split by bands of their set size and into blocks of bounded size and bytes; pairs of
blocks are the units of work, those inside the members' largest component excepted. No pair of such a unit is emitted as a row, only links that join components. Exact verification
ships a set once for each of its proposals, a leader's set once for each block of its followers. Nothing is capped or dropped.

A null or empty text, or one without words, has no shingle, is linked with nothing and is its own component. Rows with a null id are nodes like others; a component whose
rows all lack ids is null, and rows without an id are never kept. Rows with equal ids are documents of their own (kept each). Extra columns are ignored. An
empty table gives no rows. Texts of any length are shingled whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_words, mix64, shared_folder, slices, table, utf8_buffer
from .line_templates import kept_table

WORDS, SHARE = 2, (80, 100)
K, RUN, LOWEST = 48, 3, 24
BLOCK, BLOCK_SHINGLES = 1024, 1 << 22
CHUNK_BYTES = 1 << 20
BREAKS = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


# ---------- sets and sketches ----------

def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, ascending, and each text's first place (``n + 1`` places)."""
    raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    words, first = byte_words(raw, offsets, BREAKS)
    n = np.diff(first)
    many = np.maximum(n - WORDS + 1, (n > 0).astype(np.int64))
    place = np.concatenate([[0], np.cumsum(many)])
    owner = np.repeat(np.arange(len(n)), many)
    at = np.arange(place[-1]) - place[owner] + first[owner]
    padded = np.concatenate([words, np.zeros(1, np.uint64)])
    second = np.where(at + 1 < first[1:][owner], padded[at + 1], np.uint64(0))
    h = mix64(mix64(padded[at] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + second)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]) if len(h) else np.zeros(0, bool)
    h, owner = h[fresh], owner[fresh]
    return h, np.searchsorted(owner, np.arange(len(n) + 1))


def names_of(h: np.ndarray, first: np.ndarray) -> list[bytes]:
    """128-bit name of each set: two sums of differently mixed members, with the size."""
    size = np.diff(first)
    out = np.zeros((len(size), 2), dtype=">u8")
    full = size > 0
    if full.any():
        at = first[:-1][full]
        out[full, 0] = mix64(np.add.reduceat(mix64(h ^ np.uint64(0x5BF03635)), at) + size[full].astype(np.uint64))
        out[full, 1] = mix64(np.add.reduceat(mix64(h * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(5)), at))
    data = out.tobytes()
    return [data[i:i + 16] for i in range(0, len(data), 16)]


def per_text(docs: DataFrame, finish, schema: str) -> DataFrame:
    """Runs ``finish(batch rows, shingles, places)`` over pieces of ``docs`` (last column: text) that are bounded by ``CHUNK_BYTES`` (or one text)."""
    def run(batches):
        for b in batches:
            raw, off = utf8_buffer(b.column(b.num_columns - 1))
            for i, j in slices(off, CHUNK_BYTES):
                h, first = shingle_sets(raw[off[i]:off[j]], off[i:j + 1] - off[i])
                yield finish(b.slice(i, j - i), h, first)

    return docs.mapInArrow(run, schema)


def packed(h: np.ndarray, first: np.ndarray, most: int | None = None) -> pa.Array:
    """The members of each set (the ``most`` smallest) as bytes."""
    data, out = h.astype("<u8").tobytes(), []
    for x, y in zip(first[:-1].tolist(), first[1:].tolist()):
        out.append(data[8 * x:8 * (y if most is None else min(y, x + most))])
    return pa.array(out, pa.binary())


def sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``id, text_hash, node, size, sketch`` of every row."""
    def finish(b, h, first):
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names_of(h, first), pa.binary()),
                                           pa.array(np.diff(first).astype(np.int64)), packed(h, first, K)], names=["id", "text_hash", "node", "size", "sketch"])

    t = F.col(text).cast("string")
    rows = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(t).alias("text_hash"), t.alias("text"))
    return per_text(rows, finish, "id long, text_hash long, node binary, size long, sketch binary")


def set_tables(members: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """``node, members`` (the whole set as bytes) for the nodes of ``members`` (``node, id, text_hash``: one row that has this set)."""
    def finish(b, h, first):
        return pa.RecordBatch.from_arrays([b.column(0), packed(h, first)], names=["node", "members"])

    t = F.col(text).cast("string")
    texts = docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(t).alias("hash"), t.alias("text"))
    same = F.col("id").eqNullSafe(F.col("doc")) & (F.col("text_hash") == F.col("hash"))
    rows = members.hint("shuffle_hash").join(texts, same).select("node", "text")
    return per_text(rows, finish, "node binary, members binary").dropDuplicates(["node"])


MARK = np.uint64(0x9E3779B97F4A7C15)


def without_one(sketch: np.ndarray) -> np.ndarray:
    """Lists of a set of four members, or of each four of a set's five."""
    fours = [np.delete(sketch, i) for i in range(5)] if len(sketch) == 5 else [sketch]
    return mix64(np.array([np.bitwise_xor.reduce(mix64(x * MARK)) for x in fours], dtype=np.uint64) + np.uint64(7))


def list_keys(sets: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The inverted lists of each sketch and the place of their sketch: one list for each run of retained values, and ``without_one``."""
    flat = np.frombuffer(b"".join(sets), dtype="<u8")
    size = np.array([len(x) // 8 for x in sets], dtype=np.int64)
    runs = np.maximum(size - RUN + 1, 0)
    owner = np.repeat(np.arange(len(sets)), runs)
    at = np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(np.cumsum(size) - size, runs)
    key = np.zeros(len(at), np.uint64)
    for i in range(RUN):
        key = mix64(key * MARK + flat[at + i])
    small = np.flatnonzero((size == 4) | (size == 5)).tolist()
    more = [without_one(np.frombuffer(sets[i], dtype="<u8")) for i in small]
    if more:
        key = np.concatenate([key, *more])
        owner = np.concatenate([owner, *[np.full(len(x), i) for i, x in zip(small, more)]])
    return key.view(np.int64), owner


def postings(nodes: DataFrame) -> DataFrame:
    """``list, node`` of every node and list."""
    def run(batches):
        for b in batches:
            key, owner = list_keys(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(key), b.column(0).take(pa.array(owner))], names=["list", "node"])

    return nodes.where(F.col("size") > 3).select("node", "sketch").mapInArrow(run, "list long, node binary")


# ---------- components ----------

def connected(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """``node, component`` of every node with an edge. Each round moves nodes to their smallest neighbour and contracts the edges, until none is left."""
    edges = kept_table(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), folder, f"{name}-edges-0")
    place, step = None, 0
    while not edges.isEmpty():
        step += 1
        ends = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        move = kept_table(ends.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("to")), folder, f"{name}-move-{step}")
        if place is None:
            place = move.withColumnRenamed("to", "component")
        else:
            place = place.join(move.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        place = kept_table(place, folder, f"{name}-place-{step}")
        # each join is followed by an exchange, so adaptive execution can split a hub's edges
        half = edges.join(move.select(F.col("node").alias("b"), F.col("to").alias("y")), "b").select("a", "y")
        both = half.join(move.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").where("x <> y")
        edges = kept_table(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), folder, f"{name}-edges-{step}")
    return place if place is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


# ---------- exact verification ----------

def sorted_groups(batches, names: list[str]):
    """Runs of rows with equal first column as tables."""
    waiting: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        g = b.column(0).to_numpy()
        edge = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
        for x, y in zip(edge, edge[1:]):
            if waiting and g[x] != last:
                yield pa.Table.from_batches(waiting).select(names)
                waiting = []
            last = g[x]
            waiting.append(b.slice(x, y - x))
    if waiting:
        yield pa.Table.from_batches(waiting).select(names)


def exact_share(a: np.ndarray, b: np.ndarray) -> bool:
    at = np.searchsorted(a, b)
    both = int((a[np.minimum(at, len(a) - 1)] == b).sum())
    return SHARE[1] * both >= SHARE[0] * (len(a) + len(b) - both)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``hub, node`` whose whole sets are similar enough. A hub's set goes once to each block of at most about ``BLOCK`` of its pairs."""
    size = pairs.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = pairs.join(size, "hub").select("hub", "node", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"))
    hubs = size.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    group = F.xxhash64("hub", "block").alias("g")
    centre = hubs.join(sets.withColumnRenamed("node", "hub"), "hub").select(group, F.lit(0).alias("kind"), "hub", F.col("hub").alias("node"), "members")
    others = dealt.join(sets, "node").select(group, F.lit(1).alias("kind"), "hub", "node", "members")

    def run(batches):
        for t in sorted_groups(batches, ["kind", "hub", "node", "members"]):
            hub, a, b = {}, [], []
            for kind, h, n, m in zip(*[t.column(i).to_pylist() for i in range(4)]):
                own = np.frombuffer(m, dtype="<u8")
                if kind == 0:
                    hub[h] = own  # two hubs can share a group when their hashes do
                elif exact_share(hub[h], own):
                    a.append(h)
                    b.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return centre.unionByName(others).repartition("g").sortWithinPartitions("g", "kind").mapInArrow(run, "a binary, b binary")


# ---------- candidates ----------

def leaders(lists: DataFrame) -> DataFrame:
    """``list, hub, node``: each member of a list but its leader. ``lists``: ``list, node, weight``."""
    leader = lists.groupBy("list").agg(F.max(F.struct("weight", "node")).alias("top")).select("list", F.col("top.node").alias("hub"))
    return lists.join(leader, "list").where(F.col("hub") != F.col("node")).select("list", "hub", "node")


def estimates(own: np.ndarray, others: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """For a sketch and each of ``others`` (rows of ``matrix``): how many of the smallest ``K`` values of their union both hold, scaled to ``K``."""
    rows = matrix[others]
    place = np.searchsorted(own, rows)
    common = own[np.minimum(place, len(own) - 1)] == rows
    # a value's rank in the union: the values before it in its row, and those of ``own`` that the row lacks
    rank = np.arange(K)[None, :] + place - (np.cumsum(common, axis=1) - common)
    union = (rows != FILL).sum(axis=1) + len(own) - common.sum(axis=1)
    limit = np.minimum(union, K)
    return (common & (rank < limit[:, None])).sum(axis=1) * K / limit


FILL = np.uint64(0xFFFFFFFFFFFFFFFF)


def units_of(rest: DataFrame) -> DataFrame:
    """``g, cross, side, node, component, members``: the units of work. ``rest``: ``hub, node, component, size, members``.

    A leader's few members are one unit. Many are dealt to bands first: sizes whose ratio is 0.8 or more lie in one band or in neighbouring ones, so a member goes
    to its own band and, as ``upper``, to the next one. In a band the largest component (the major members) is compared with the others (minor), block by block,
    and these with each other; what is inside the major one needs no comparison.
    """
    heavy = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES))
    many = rest.groupBy("hub").agg(heavy.alias("blocks"))
    band = F.floor(F.log(F.col("size").cast("double")) / float(-np.log(SHARE[0] / SHARE[1])) + 1e-9)
    rows = rest.join(many, "hub").withColumn("upper", F.explode(F.when(F.col("blocks") > 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    rows = rows.withColumn("meet", F.when(F.col("blocks") > 1, band + F.col("upper")).otherwise(F.lit(-1).cast("long"))).drop("blocks")
    sizes = rows.groupBy("hub", "meet", "component").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("upper").alias("low"))
    top = sizes.groupBy("hub", "meet").agg(F.max(F.struct("n", "bytes", "component")).alias("major"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.min("low").alias("low"))
    part = F.greatest(F.ceil((F.col("n") - F.col("major.n")) / BLOCK), F.ceil((F.col("bytes") - F.col("major.bytes")) / BLOCK_SHINGLES))
    whole = F.greatest(F.ceil(F.col("major.n") / BLOCK), F.ceil(F.col("major.bytes") / BLOCK_SHINGLES))
    # without minor members all are one component; without members of its own the band is compared below
    top = top.where((F.col("n") > F.col("major.n")) & (F.col("low") == 0)).select("hub", "meet", F.col("major.component").alias("major"), part.alias("minors"), whole.alias("majors"))
    rows = rows.join(top, ["hub", "meet"])
    is_major = F.col("component") == F.col("major")
    own = F.pmod(F.xxhash64("node"), F.when(is_major, F.col("majors")).otherwise(F.col("minors")))

    def unit(kind: int, first, second, side):
        return F.struct(F.lit(kind).alias("kind"), first.cast("long").alias("first"), second.cast("long").alias("second"), F.lit(side).alias("side") if isinstance(side, int) else side.cast("int").alias("side"))

    minors, majors = (F.sequence(F.lit(0).cast("long"), F.col(c) - 1) for c in ("minors", "majors"))
    among = F.transform(minors, lambda x: unit(0, F.least(own, x), F.greatest(own, x), own > x))
    against = F.transform(majors, lambda x: unit(1, own, x, 0))
    units = rows.withColumn("u", F.explode(F.when(is_major, F.transform(minors, lambda x: unit(1, x, own, 1))).otherwise(F.concat(among, against))))
    cross = (F.col("u.kind") == 1) | (F.col("u.first") != F.col("u.second"))
    return units.select(F.xxhash64("hub", "meet", "u.kind", "u.first", "u.second").alias("g"), cross.alias("cross"), F.col("u.side").alias("side"), "upper", "node", "component", "members")


def joining_links(units: DataFrame) -> DataFrame:
    """``a, b``: links that join components, a spanning forest of each unit."""
    part, whole = SHARE

    def run(batches):
        for t in sorted_groups(batches, ["cross", "side", "upper", "node", "component", "members"]):
            cross, names, sets = t.column(0)[0].as_py(), t.column(3).to_pylist(), [np.frombuffer(x, dtype="<u8") for x in t.column(5).to_pylist()]
            side, upper = (t.column(i).to_numpy() for i in (1, 2))
            size = np.array([len(x) for x in sets])
            component = np.unique(np.array([x.hex() for x in t.column(4).to_pylist()]), return_inverse=True)[1]
            sketch = [x[:K] for x in sets]
            matrix = np.full((len(sets), K), FILL, dtype=np.uint64)
            for i, x in enumerate(sketch):
                matrix[i, :len(x)] = x
            a, b = [], []
            for i in np.flatnonzero(side == 0).tolist() if cross else range(len(sets)):
                ok = (component != component[i]) & ~((upper == 1) & (upper[i] == 1)) & (whole * size >= part * size[i]) & (whole * size[i] >= part * size)
                if cross:
                    ok &= side == 1
                else:
                    ok[:i] = False
                at = np.flatnonzero(ok)
                if len(at):
                    for j in at[estimates(sketch[i], at, matrix) >= LOWEST].tolist():
                        if component[j] != component[i] and exact_share(sets[i], sets[j]):
                            component[component == component[j]] = component[i]
                            a.append(names[i])
                            b.append(names[j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return units.repartition("g").sortWithinPartitions("g").mapInArrow(run, "a binary, b binary")


# ---------- documents ----------

def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, n_shingles, component_id, kept`` for every row of ``docs``."""
    folder = shared_folder(docs.sparkSession, "bottom")
    rows = kept_table(sketches(docs, key, text), folder, "sketches")
    one = F.min(F.struct("id", "text_hash"))
    nodes = kept_table(rows.where("size > 0").groupBy("node").agg(F.min("id").alias("least"), one.alias("one"), F.first("size").alias("size"), F.first("sketch").alias("sketch")), folder, "nodes")
    all_lists = postings(nodes)
    shared = all_lists.groupBy("list").count().where(F.col("count") > 1)
    met = kept_table(all_lists.join(shared, "list"), folder, "met")
    # a node's weight: how many other nodes its lists hold
    weight = met.groupBy("node").agg(F.sum("count").alias("weight"))
    lists = met.drop("count").join(weight, "node")
    candidates = kept_table(weight.join(nodes.select("node", "one.id", "one.text_hash"), "node").select("node", "id", "text_hash"), folder, "candidates")
    sets = kept_table(set_tables(candidates, docs, key, text), folder, "sets")
    led = kept_table(leaders(lists), folder, "led")
    first = kept_table(verified(led.select("hub", "node").distinct(), sets), folder, "links-1")
    start = connected(first, folder, "first")
    # lists whose members (without the leader, which has met all of them) are not one component yet
    now = kept_table(led.join(start, "node", "left").withColumn("component", F.coalesce("component", "node")), folder, "now")
    split = now.groupBy("list").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("list")
    rest = now.join(split, "list", "left_semi").select("hub", "node", "component").distinct()
    units = units_of(kept_table(rest.join(sets.join(nodes.select("node", "size"), "node"), "node"), folder, "rest"))
    second = kept_table(joining_links(units), folder, "links-2")
    whole = connected(first.unionByName(second), folder, "whole")
    least = whole.join(nodes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("component_id"))
    named = kept_table(whole.join(least, "component").select("node", "component_id"), folder, "named")
    ids = nodes.select("node", "least").join(named, "node", "left").select("node", F.coalesce("component_id", "least").alias("component_id"))
    with_words = rows.where("size > 0").join(ids, "node").select("id", F.col("size").alias("n_shingles"), "component_id")
    without = rows.where("size = 0").select("id", F.col("size").alias("n_shingles"), F.col("id").alias("component_id"))
    return with_words.unionByName(without).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))


def op13_bottom_k(spark, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id").select("doc_id", "n_shingles", "component_id", "kept")


OP13_SQL = """
WITH RECURSIVE
words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'),
  lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
rare AS (SELECT doc_id, n, shingle, row_number() OVER (PARTITION BY doc_id ORDER BY df, shingle) AS place FROM (SELECT *, count(*) OVER (PARTITION BY shingle) AS df FROM flat)),
pairs AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM rare a JOIN rare b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  WHERE 5 * (a.place - 1) <= a.n AND 5 * (b.place - 1) <= b.n AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n),
counted AS (SELECT p.x, p.y, count(*) AS shared, any_value(a.n) AS n, any_value(b.n) AS m FROM pairs p JOIN flat a ON a.doc_id = p.x JOIN flat b ON b.doc_id = p.y AND b.shingle = a.shingle GROUP BY p.x, p.y),
links AS (SELECT x, y FROM counted WHERE 100 * shared >= 80 * (n + m - shared)),
near AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, n.y FROM reach r JOIN near n ON n.x = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, l.component_id, s.doc_id = l.component_id AS kept FROM sets s JOIN least l ON l.doc_id = s.doc_id
"""
