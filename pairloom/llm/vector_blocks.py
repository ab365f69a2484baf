"""Vector tables as shards and query blocks, shared by the two searches.

Every row of the table goes to one shard of bounded size, every query to one block of bounded size; a search runs for each
(shard, block) pair and returns its best rows, and the lists of a query are merged. No group, broadcast or driver list grows
with the table: a shard's rows are copied once per query block and a query once per shard.

A vector takes part when it is not null, has the table's dimension (the most frequent one, of equals the larger), at least one component and only finite
components. Rows with equal ids are candidates each; as queries they count once, with the smallest of their vectors. A table
without such vectors gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 8192
BLOCK_QUERIES = 4096


def usable_vectors(df: DataFrame, key: str, vector: str, nonzero: bool) -> DataFrame:
    """``id long, v array<double>`` of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    ok = F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False)) & (F.size(F.col(vector)) > 0) & F.col(key).isNotNull()
    if nonzero:
        ok = ok & F.exists(v, lambda x: x != 0)
    return df.where(ok).select(F.col(key).cast("long").alias("id"), v.alias("v"))


def dimension(rows: DataFrame) -> tuple[int, int]:
    """The most frequent dimension (of equals the larger) and the number of rows that have it: one small aggregate."""
    by = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return (by[0][0], by[0][1]) if by else (0, 0)


def to_matrix(table: pa.Table, column: str) -> np.ndarray:
    col = table.column(column).combine_chunks()
    if not len(col):
        return np.zeros((0, 0))
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def blocked(rows: DataFrame, queries: DataFrame, n_rows: int, n_queries: int, result: str,
            search: Callable[[pa.Table, pa.Table], pa.Table], shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Runs ``search(rows of a shard, queries of a block)`` for every pair and returns all its rows."""
    shards = max(1, -(-n_rows // shard_rows))
    blocks = max(1, -(-n_queries // BLOCK_QUERIES))
    left = rows.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards))).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    right = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<bigint>")))
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # both sides may stem from one table
    pairs = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block"))
    empty = pa.schema([(n, {"long": pa.int64(), "double": pa.float64()}[t]) for n, t in (x.split() for x in result.split(", "))])

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return search(a, b) if a.num_rows and b.num_rows else empty.empty_table()

    return pairs.applyInArrow(run, result)


def best(found: DataFrame, k: int, score: Column) -> DataFrame:
    """The ``k`` best rows of each query: a merge of one short list per shard."""
    w = Window.partitionBy("query_id").orderBy(score.desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_rows(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to smaller ids, in that order."""
    if len(score) > 4 * k:
        kth = np.partition(score, len(score) - k)[len(score) - k]
        keep = np.flatnonzero(score >= kth)
        return keep[np.lexsort((ids[keep], -score[keep]))[:k]]
    return np.lexsort((ids, -score))[:k]
