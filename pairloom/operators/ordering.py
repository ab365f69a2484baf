"""Dense indices, shards, drop-shortest, sampling and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import h
from .indexing import hash_row_index, range_row_index, select_first

FLAT_ORDER = [("len", False), ("subset", True), ("id", True), ("column", True)]


def dense_index(flat: DataFrame, out: str = "emb_idx", order: Sequence[tuple[str, bool]] | None = None) -> DataFrame:
    """``emb_idx`` = position after the length-descending sort (ties by subset, id, column[, slot])."""
    if order is None:
        order = FLAT_ORDER + ([("slot", True)] if "slot" in flat.columns else [])
    return range_row_index(flat, order, out=out, by_row=True)  # the longest texts are one range


def drop_shortest(indexed: DataFrame, n: int, idx: str = "emb_idx", share: float = 0.01) -> DataFrame:
    """Drop the last ``int(n·share)`` rows of the length-descending order (none when that is 0)."""
    drop = int(n * share)
    return indexed.filter(F.col(idx) < n - drop)


def shard_rows(indexed: DataFrame, n: int, shards: int, idx: str = "emb_idx") -> DataFrame:
    """Contiguous shards of ``n // shards`` rows; the last shard takes the remainder."""
    size = n // shards
    shard = F.least(F.floor(F.col(idx) / F.lit(size)), F.lit(shards - 1)) if size > 0 else F.lit(shards - 1)
    return indexed.withColumn("shard", shard.cast("int"))


def sample_per_key(df: DataFrame, n: int | None, seed: int, key_cols: Sequence[str], group: Sequence[str] = (),
                   frac: float | None = None) -> DataFrame:
    """Seeded shuffle, then the first ``n`` rows (per group when ``group``); ``n=None`` keeps all, shuffled.

    The order is ``h(seed, keys)``. The first ``n`` rows are found by radix selection (``select_first``), so neither a
    large group nor a large ``n`` is sorted in one task; positions come from the salted index over the chosen rows.
    """
    hk = h(seed, *[F.col(k) for k in key_cols])
    if n is None:
        return hash_row_index(df, list(group), hk, list(key_cols), out="_rk")
    limits = df.select(*group).distinct().withColumn("n", F.lit(int(n))) if group else one_limit(df, n)
    return hash_row_index(select_first(df, limits, hk, list(key_cols), group), list(group), hk, list(key_cols), out="_rk")


def one_limit(df: DataFrame, n: int) -> DataFrame:
    """``limits`` of :func:`select_first` without groups."""
    return df.sparkSession.range(1).select(F.lit(int(n)).alias("n"))


def train_test_split(df: DataFrame, seed: int, key_cols: Sequence[str]) -> DataFrame:
    """``split`` = test for the first ``max(1, int(min(0.1·n, 1000)))`` rows by hash order, else train.

    The test set is a top-k by hash (``orderBy(...).limit(k)``: each task keeps k rows before one merge), at
    most 1000 keys, broadcast back to mark the rows.
    """
    n = df.count()
    test = max(1, int(min(n * 0.1, 1000))) if n > 1 else 1
    hk = h(seed, "split", *[F.col(k) for k in key_cols])
    test_keys = df.select(*key_cols).orderBy(hk, *[F.col(k) for k in key_cols]).limit(test)
    marked = df.join(F.broadcast(test_keys.withColumn("_test", F.lit(True))), list(key_cols), "left")
    return marked.withColumn("split", F.when(F.col("_test"), "test").otherwise("train")).drop("_test")


def first_rows(df: DataFrame, n: int, key: str) -> DataFrame:
    """The first ``n`` rows by ``key`` (a top-n: Spark plans a bounded TakeOrdered)."""
    return df.orderBy(key).limit(n)
