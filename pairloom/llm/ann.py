"""Approximate nearest neighbours by multiprobe p-stable hashing (operator 1).

Largest inner product becomes nearest in Euclidean distance: vectors are divided by the largest norm and get one
more component that makes them unit length, queries are made unit length. Each table hashes a vector by ``m``
Gaussian projections cut at width ``w``. A query visits its own bucket and then buckets one step away in one or more
projections, in the order of estimated success: the sum of squared distances to the crossed borders. The order over
sorted border distances is fixed beforehand from their expected values. Candidates of all tables are merged and
reranked by the exact inner product in double precision.

The index covers every row. The table is sharded by rows, and each shard holds the buckets of its own rows for all
hash tables, so a hot bucket is spread over all shards, and the candidate set is that of one global index.

Vectors that are null, zero or hold null or non-finite components take no part. Ties go to the smaller id. See
``vector_blocks`` for repeated ids and empty tables. Extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table
from .vector_blocks import best, blocked, dimension, to_matrix, top_rows, usable_vectors

TABLES, PROJECTIONS, WIDTH, PROBES, SEED = 8, 8, 2.0, 250, 20


def probe_sets(m: int, probes: int) -> np.ndarray:
    """Row 0 is the query's own bucket; each further row marks which of the ``2 m`` borders, sorted by distance, are crossed."""
    j = np.arange(1, m + 1)
    near = j * (j + 1) / (4 * (m + 1) * (m + 2))
    far = 1 - (2 * m + 1 - (m + j)) / (m + 1) + (2 * m + 1 - (m + j)) * (2 * m + 2 - (m + j)) / (4 * (m + 1) * (m + 2))
    cost = np.concatenate([near, far])
    out, heap = [()], [(cost[0], (0,))]
    while heap and len(out) < probes:
        total, chosen = heapq.heappop(heap)
        if not any(2 * m - 1 - x in chosen for x in chosen):  # both borders of one projection
            out.append(chosen)
        last = chosen[-1] + 1
        if last < 2 * m:
            heapq.heappush(heap, (total - cost[last - 1] + cost[last], (*chosen[:-1], last)))
            heapq.heappush(heap, (total + cost[last], (*chosen, last)))
    marks = np.zeros((len(out), 2 * m), dtype=bool)
    for row, chosen in enumerate(out):
        marks[row, list(chosen)] = True
    return marks


class HashTables:
    def __init__(self, d: int, tables: int, m: int, width: float, probes: int, seed: int):
        rng = np.random.default_rng(seed)
        self.a = rng.normal(size=(tables, d, m))
        self.b = rng.uniform(0, width, size=(tables, m))
        self.mix = rng.integers(1, 1 << 62, size=(tables, m), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.tables, self.m, self.width, self.marks = tables, m, width, probe_sets(m, probes)

    def cells(self, x: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Bucket key of each row and its place inside the bucket along each projection."""
        p = (x @ self.a[t] + self.b[t]) / self.width
        cell = np.floor(p)
        return (cell.astype(np.int64).astype(np.uint64) * self.mix[t]).sum(axis=1, dtype=np.uint64), (p - cell) * self.width

    def probes(self, q: np.ndarray, t: int) -> np.ndarray:
        """Keys of the buckets that each query visits, in order."""
        own, at = self.cells(q, t)
        border = np.concatenate([at, self.width - at], axis=1)
        step = np.concatenate([np.zeros_like(self.mix[t]) - self.mix[t], self.mix[t]])
        order = np.argsort(border, axis=1, kind="stable")
        sorted_step = step[order]
        keys = np.repeat(own[:, None], len(self.marks), axis=1)
        for j in range(2 * self.m):
            keys += sorted_step[:, j:j + 1] * self.marks[:, j].astype(np.uint64)
        return keys


def candidates(index: HashTables, x: np.ndarray, q: np.ndarray, step: int = 256):
    """For blocks of queries: a row of marks over ``x`` per query, true where some table's visited bucket holds the row."""
    built = []
    for t in range(index.tables):
        key = index.cells(x, t)[0]
        order = np.argsort(key, kind="stable")
        names, first, count = np.unique(key[order], return_index=True, return_counts=True)
        built.append((order, names, first, count))
    for i in range(0, len(q), step):
        part = q[i:i + step]
        seen = np.zeros((len(part), len(x)), dtype=bool)
        for t, (order, names, first, count) in enumerate(built):
            keys = index.probes(part, t)
            at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
            row, probe = np.nonzero(names[at] == keys)
            hit = at[row, probe]
            size = count[hit]
            offset = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            seen[np.repeat(row, size), order[np.repeat(first[hit], size) + offset]] = True
        yield i, seen


def nearest(df: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding", tables: int = TABLES,
            m: int = PROJECTIONS, width: float = WIDTH, probes: int = PROBES, seed: int = SEED) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found rows of each query row (``is_query`` is over column ``id``)."""
    rows = usable_vectors(df, key, vector, nonzero=True)
    d, n = dimension(rows)
    rows = rows.where(F.size("v") == d)
    queries = rows.where(is_query).groupBy("id").agg(F.min("v").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    counts = rows.agg(F.max(norm), F.sum(F.when(is_query, 1).otherwise(0))).first()
    largest, n_queries = counts[0] or 1.0, counts[1] or 0

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        x, ids = to_matrix(a, "v"), a.column("id").to_numpy()
        q, query_ids = to_matrix(b, "v"), b.column("id").to_numpy()
        unit = x / largest
        unit = np.concatenate([unit, np.sqrt(np.maximum(0, 1 - (unit * unit).sum(axis=1)))[:, None]], axis=1)
        asked = np.concatenate([q / np.linalg.norm(q, axis=1)[:, None], np.zeros((len(q), 1))], axis=1)
        index = HashTables(d + 1, tables, m, width, probes, seed)
        out = []
        for i, seen in candidates(index, unit, asked):
            for j in range(len(seen)):
                place = np.flatnonzero(seen[j] & (ids != query_ids[i + j]))
                score = x[place] @ q[i + j]
                top = top_rows(score, ids[place], k)
                out.append((np.full(len(top), query_ids[i + j]), ids[place][top], score[top]))
        return pa.table({"query_id": np.concatenate([o[0] for o in out]).astype(np.int64),
                         "vec_id": np.concatenate([o[1] for o in out]).astype(np.int64),
                         "score": np.concatenate([o[2] for o in out]).astype(np.float64)})

    found = blocked(rows, queries, n, n_queries, "query_id long, vec_id long, score double", search)
    return best(found, k, F.col("score"))


def op1_ann(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)
