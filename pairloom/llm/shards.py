"""Weighted hash tree of shards (operator 3, DataFrame functions only).

The tree has three levels: regions, their racks, their shards. From the root down, each child of a node draws
``-ln(u) / weight``, with ``u`` a uniform hash of (key, child), and the smallest draw wins. A child's weight is
the sum of its leaves. A draw depends on nothing but the key, the child's name and its weight, so a change of weights moves keys only
into or out of the subtrees whose weight changed; keys elsewhere keep their place.

Growth: a further shard enters as a region of its own. Every other draw stays as it was, so a key that moves can only move
to the new shard (law ``key``).

Slots: inside each shard the rows are numbered from 0. A shard is cut by the partition that holds the row, the
pieces are numbered by themselves, and a small table of piece sizes (shards x partitions) gives the offsets, so a
shard or key with any share of the rows is numbered by many tasks.

A null key is a key like any other. Rows with equal keys share a shard and have slots of their own; equal texts under different
keys need not share one. An empty table gives no rows. Only the named key and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, table, utf8_size

#: Rows of (region, rack, shard, weight).
Tree = list[tuple[str, str, int, float]]


def even_tree(shards: int, per_rack: int = 2, racks: int = 2) -> Tree:
    """Shards of equal weight, filled rack by rack and region by region."""
    return [(f"region{s // (per_rack * racks)}", f"rack{s // per_rack}", s, 1.0) for s in range(shards)]


def grown(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, which is a region of its own."""
    new = max((leaf[2] for leaf in tree), default=-1) + 1
    return [*tree, (f"grown-region{new}", f"grown-rack{new}", new, weight)]


def draw(key: Column, name: str, weight: float) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11).cast("double") + F.lit(0.5)) * F.lit(2.0 ** -53)
    return -F.log(u) / F.lit(float(weight))


def winner(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """The value of the child with the smallest draw."""
    if len(children) == 1:
        return children[0][2]
    drawn = [F.struct(draw(key, name, w).alias("d"), F.lit(name).alias("name"), value.alias("v")) for name, w, value in children]
    return F.least(*drawn).getField("v")


def place(key: Column, tree: Tree, path: tuple[str, ...] = ()) -> Column:
    """The shard of ``key``: a descent of region, rack and shard draws. Leaves of weight 0 get nothing."""
    level = len(path)
    here: dict[str, list] = {}
    for leaf in tree:
        if leaf[3] > 0:
            here.setdefault(str(leaf[level]), []).append(leaf)
    if not here:
        raise ValueError("the tree has no shard of positive weight")
    children = []
    for name, leaves in sorted(here.items()):
        full = (*path, name)
        value = F.lit(int(leaves[0][2])) if level == 2 else place(key, leaves, full)
        children.append(("/".join(full), sum(leaf[3] for leaf in leaves), value))
    return winner(key, children)


def assign_shards(docs: DataFrame, tree: Tree, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, size, text_crc32, law, shard, slot, grown_shard`` for every row."""
    crc = F.crc32(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))
    k = F.col(key)
    rows = settle(docs.select(
        k.alias("key"), (utf8_size(text) + 1).alias("size"), crc.alias("text_crc32"),
        place(k, tree).alias("shard"), place(k, grown(tree)).alias("grown_shard"), F.spark_partition_id().alias("piece")))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "piece").count().select(
        "shard", "piece", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "piece").orderBy(F.col("key").asc_nulls_first(), "size", "text_crc32")
    return rows.withColumn("n", F.row_number().over(within) - 1).join(starts, ["shard", "piece"]).select(
        F.col("key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("start") + F.col("n")).alias("slot"), "grown_shard")


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), even_tree(16))
