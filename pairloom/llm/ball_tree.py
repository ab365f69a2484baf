"""Exact top-k inner products by ball trees (operator 7).

Each shard of bounded size builds a ball tree. A node's inner product with a query is at most ``q . centre + |q| radius``; nodes are
visited in the order of that bound and a node whose bound is below the current k-th score is pruned with all below it.
The k-th score is shared between shards: a first round searches one shard per query, and its k-th score, a lower bound of
the final one, starts the second round in all other shards, so those return only rows that can still enter.

Scores are exact integers. Ties go to the smaller id, and a node is pruned only when its bound is strictly lower. Vectors that are null or hold
null or non-finite components take no part; a zero vector scores 0. See ``vector_blocks`` for repeated ids and empty tables.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table
from .vector_blocks import SHARD_ROWS, best, blocked, dimension, to_matrix, top_rows, usable_vectors

LEAF_ROWS = 64


class BallTree:
    """Nodes as arrays: rows ``order[first:last]``, centre, radius, and two children (-1: a leaf)."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF_ROWS):
        self.order = np.arange(len(x))
        self.first, self.last, self.child, centre, radius = [], [], [], [], []
        todo = [(0, len(x), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            rows = self.order[a:b]
            c = x[rows].mean(axis=0)
            dist = np.sqrt(((x[rows] - c) ** 2).sum(axis=1))
            node = len(self.first)
            if parent >= 0:
                self.child[parent][side] = node
            self.first.append(a)
            self.last.append(b)
            self.child.append([-1, -1])
            centre.append(c)
            radius.append(dist.max())
            if b - a > leaf and dist.max() > 0:
                far = x[rows[dist.argmax()]]
                other = x[rows[((x[rows] - far) ** 2).sum(axis=1).argmax()]]
                half = (b - a) // 2
                self.order[a:b] = rows[np.argpartition(x[rows] @ (other - far), half)]
                todo += [(a, a + half, node, 0), (a + half, b, node, 1)]
        self.centre, self.radius = np.array(centre), np.array(radius)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Upper bound of the inner product of each query with any row of each node, rounding included."""
        length = np.linalg.norm(q, axis=1)[:, None]
        reach = np.linalg.norm(self.centre, axis=1) + self.radius
        return q @ self.centre.T + length * self.radius + 1e-9 * length * reach + 1e-6


def integer_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows held as doubles."""
    if x.size and float(np.abs(x).max()) * float(np.abs(q).max()) * len(q) >= 2.0 ** 52:
        return x.astype(np.int64) @ q.astype(np.int64)
    return (x @ q).astype(np.int64)


def search_tree(tree: BallTree, x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: int, bound: np.ndarray, k: int,
                start: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the best ``k`` rows with a score of ``start`` or more."""
    kth, got_ids, got = start, np.zeros(0, np.int64), np.zeros(0, np.int64)
    heap = [(-bound[0], 0)]
    while heap:
        b, node = heapq.heappop(heap)
        if -b < kth:
            break
        left, right = tree.child[node]
        if left >= 0:
            for c in (left, right):
                if bound[c] >= kth:
                    heapq.heappush(heap, (-bound[c], c))
            continue
        rows = tree.order[tree.first[node]:tree.last[node]]
        score = integer_scores(x[rows], q)
        keep = (score >= kth) & (ids[rows] != own)
        if keep.any():
            got, got_ids = np.concatenate([got, score[keep]]), np.concatenate([got_ids, ids[rows][keep]])
            top = top_rows(got, got_ids, k)
            got, got_ids = got[top], got_ids[top]
            if len(got) == k:
                kth = max(kth, float(got[-1]))
    return got_ids, got


def exact_top(df: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` over vectors of integers held as doubles; ``is_query`` is over column ``id``."""
    rows = usable_vectors(df, key, vector, nonzero=False)
    d, n = dimension(rows)
    rows = rows.where(F.size("v") == d)
    queries = rows.where(is_query).groupBy("id").agg(F.min("v").alias("v"))
    n_queries = rows.where(is_query).count()

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        x, ids = to_matrix(a, "v"), a.column("id").to_numpy()
        q, query_ids, start = to_matrix(b, "v"), b.column("id").to_numpy(), b.column("start").to_numpy()
        tree = BallTree(x)
        out = []
        for i in range(0, len(q), 512):
            bound = tree.bounds(q[i:i + 512])
            for j in range(len(bound)):
                got_ids, got = search_tree(tree, x, ids, q[i + j], query_ids[i + j], bound[j], k, start[i + j])
                out.append((np.full(len(got), query_ids[i + j]), got_ids, got))
        return pa.table({c: np.concatenate([o[i] for o in out]).astype(np.int64) for i, c in enumerate(("query_id", "vec_id", "score"))})

    result = "query_id long, vec_id long, score long"
    # first round: the first shard only, so that every query has a k-th score to start from
    first = rows.where(F.pmod(F.xxhash64("id", "v"), F.lit(max(1, -(-n // SHARD_ROWS)))) == 0)
    seeds = blocked(first, queries.withColumn("start", F.lit(float("-inf"))), 1, n_queries, result, search)
    kth = best(seeds, k, F.col("score")).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("start"))
    informed = queries.join(kth, "id", "left").fillna(float("-inf"), ["start"])
    return best(blocked(rows, informed, n, n_queries, result, search), k, F.col("score"))


def op7_ball_tree(spark, sf_dir: str) -> DataFrame:
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    whole = table(spark, sf_dir, "embeddings").where(F.coalesce(finite, F.lit(False))).select(
        "vec_id", F.transform(x, lambda c: F.floor(c * 256).cast("double")).alias("embedding"))
    return exact_top(whole, F.col("id") % 50 == 0, k=5)


OP7_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
