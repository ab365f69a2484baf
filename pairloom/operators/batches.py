"""Training batch planning as table operators.

A batch plan is a column set on the rows: ``task``, ``batch_no`` (inside the task), ``batch_id``
(global order of batches), ``row_in_batch``. Every shuffle is a hash order of ``seed + epoch``, so an
epoch's plan does not depend on earlier epochs (Quirk 14).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import h
from ..session import cut_lineage
from .folds import chain_blocks
from .indexing import DEFAULT_ROWS_PER_SLICE, hash_row_index, null_safe_join


def _bits(rows: int, rows_per_slice: int = DEFAULT_ROWS_PER_SLICE) -> int:
    """Salt bits for a group of ``rows`` rows (same rule as the index helper's own estimate)."""
    return 0 if rows <= rows_per_slice else min(16, math.ceil(math.log2(rows / rows_per_slice)))


def task_key(df: DataFrame, label_group_subsets: Sequence[str] = (), subset: str = "subset", label: str = "label") -> Column:
    """The task of a row: its subset, or ``subset|label`` for the listed subsets (label NULL → '')."""
    if not label_group_subsets or label not in df.columns:
        return F.col(subset)
    lab = F.coalesce(F.col(label).cast("string"), F.lit(""))
    return F.when(F.col(subset).isin(*label_group_subsets), F.concat(F.col(subset), F.lit("|"), lab)).otherwise(F.col(subset))


BATCH_RUN = 65_536  # batch numbers of a task that are listed at a time


def batch_plan(df: DataFrame, key_cols: Sequence[str], per_rank: int, world: int, seed: int = 42, epoch: int = 0,
               label_group_subsets: Sequence[str] = (), drop_last: bool = True, shuffle: bool = True,
               shuffle_batches: bool = True, single_task: bool = False) -> DataFrame:
    """W10 (and W12 with ``single_task``): fixed global batches of ``per_rank · world`` rows per task.

    Rows are ordered inside their task by ``h(seed+epoch, keys)`` (or by key when not shuffled), cut
    into batches; a short last batch is dropped with ``drop_last``; batches are ordered by
    ``h(seed+epoch, task, batch_no)`` (validation: task then batch_no).
    """
    g = per_rank * world
    s = seed + epoch
    keys = [F.col(k) for k in key_cols]
    d = df.withColumn("task", F.lit("all") if single_task else task_key(df, label_group_subsets))
    order = h(s, "row", *keys) if shuffle else F.lit(0)
    # one small aggregate (a row per task) sizes both salted indices below and gives all batches: no row is counted again
    sizes = cut_lineage(d.groupBy("task").agg(F.count(F.lit(1)).alias("_n")))
    biggest, total = sizes.agg(F.max("_n"), F.sum("_n")).first()
    d = hash_row_index(d, ["task"], order, list(key_cols), out="_rn", bits=_bits(biggest or 0))
    d = d.withColumn("batch_no", F.floor(F.col("_rn") / g).cast("bigint")).withColumn("row_in_batch", (F.col("_rn") % g).cast("int"))
    count = F.floor(F.col("_n") / g) if drop_last else F.ceil(F.col("_n") / g)
    zero = F.lit(0).cast("bigint")
    runs = sizes.select("task", count.cast("bigint").alias("_c")).where("_c > 0").withColumn(
        "_r", F.explode(F.sequence(zero, F.floor((F.col("_c") - 1) / BATCH_RUN))))
    low = F.col("_r") * BATCH_RUN
    batches = runs.select("task", F.explode(F.sequence(low, F.least(low + BATCH_RUN, "_c") - 1)).alias("batch_no"))
    border = h(s, "batch", F.col("task"), F.col("batch_no")) if shuffle_batches else F.lit(0)
    batches = hash_row_index(batches, [], border, ["task", "batch_no"], out="batch_id", bits=_bits(-(-(total or 0) // g)))
    return null_safe_join(d, batches, ["task", "batch_no"]).drop("_rn")


def align_negatives(df: DataFrame, batch: str = "batch_id", neg: str = "neg", neg_idx: str = "neg_emb_idx",
                    max_neg: int | None = None) -> DataFrame:
    """Trim neg / neg_idx to their common length, cap per row, then to the batch's smallest count K."""
    m = F.least(F.coalesce(F.size(neg), F.lit(0)), F.coalesce(F.size(neg_idx), F.lit(0)))
    if max_neg is not None:
        m = F.least(m, F.lit(max_neg))
    d = df.withColumn("_m", m)
    # one batch = per_rank · world rows: a bounded window
    d = d.withColumn("k", F.min("_m").over(Window.partitionBy(batch)).cast("int"))
    empty_s, empty_i = F.array().cast("array<string>"), F.array().cast("array<bigint>")
    d = d.withColumn(neg, F.when(F.col("k") > 0, F.slice(neg, 1, F.col("k"))).otherwise(empty_s))
    d = d.withColumn(neg_idx, F.when(F.col("k") > 0, F.slice(neg_idx, 1, F.col("k"))).otherwise(empty_i))
    return d.drop("_m")


def rank_slice(df: DataFrame, world: int, batch: str = "batch_id", row: str = "row_in_batch") -> DataFrame:
    """Each rank takes ``max(1, n // world)`` consecutive rows of its batch; the remainder is unused."""
    n = F.count(F.lit(1)).over(Window.partitionBy(batch))
    per = F.greatest(F.lit(1), F.floor(n / world))
    d = df.withColumn("_per", per).withColumn("rank", F.floor(F.col(row) / F.col("_per")).cast("int"))
    return d.filter(F.col("rank") < world).withColumn("row_in_rank", (F.col(row) - F.col("rank") * F.col("_per")).cast("int")).drop("_per")


def micro_chunks(df: DataFrame, n_chunks: int, group: Sequence[str], pos: str) -> DataFrame:
    """Split each group's rows (positions ``pos`` = 0..L-1) into ``n_chunks`` contiguous parts,
    the first ``L mod n`` parts one row longer."""
    L = F.count(F.lit(1)).over(Window.partitionBy(*group))
    q, r = F.floor(L / n_chunks), L % n_chunks
    p = F.col(pos)
    big = r * (q + 1)
    chunk = F.when(p < big, F.floor(p / (q + 1))).otherwise(r + F.floor((p - big) / F.greatest(q, F.lit(1))))
    return df.withColumn("chunk", chunk.cast("int"))


def _batch_lengths(neg: np.ndarray, n_rem: int, per_rank: int, world: int, max_pairs: int | None, max_neg: int | None,
                   drop_last: bool) -> np.ndarray:
    """For each position of a block, the rows of a batch that would start there (0: none, the task ends).

    The rows looked at are the next ``per_rank * world``; their smallest negative count sets the pairs per row, and
    the pair budget divided by it the rows per rank.
    """
    ahead = per_rank * world
    neg = neg[:max(n_rem, 0)]
    size = np.full(len(neg), ahead, dtype=np.int64)
    if max_pairs is not None and len(neg):
        padded = np.concatenate([neg.astype(np.int64), np.full(ahead - 1, np.iinfo(np.int64).max)])
        least = np.lib.stride_tricks.sliding_window_view(padded, ahead).min(axis=1)
        pairs = 1 + np.clip(least, 0, None if max_neg is None else max(max_neg, 0))
        size = np.where(pairs > 1, np.clip(max_pairs // pairs, 1, per_rank), per_rank) * world
    left = np.maximum(n_rem - np.arange(len(neg)), 0)
    return np.where((size > left) & drop_last, 0, np.minimum(size, left))


def _block_map(length: np.ndarray, s_eff: int, n_rem: int, entries: int) -> list[tuple[int, int]]:
    """(exit offset or -1, batches started) for every entry offset, by one pass over the block from its end."""
    last = min(s_eff, n_rem)
    out = [(-1, 0)] * max(last, entries)
    for p in range(last, entries):
        out[p] = (p - s_eff, 0) if s_eff <= p < n_rem else (-1, 0)
    for p in range(last - 1, -1, -1):
        to = p + int(length[p])
        if to > p:
            exit_, n = out[to] if to < last else (to - s_eff if to < n_rem else -1, 0)
            out[p] = (exit_, n + 1)
    return out[:entries]


def _batch_starts(length: np.ndarray, s_eff: int, n_rem: int, entry: int) -> list[tuple[int, int]]:
    """(start, rows) of the batches of a block that is entered at ``entry``."""
    out, at = [], entry
    while at < min(s_eff, n_rem) and length[at]:
        out.append((at, int(length[at])))
        at += int(length[at])
    return out


def negative_count(df: DataFrame, column: str | None = None) -> Column:
    """Negatives of a row: ``column``, else the first that is there of ``neg_len``, ``neg_num`` (counts), ``neg_emb_idx``, ``neg`` (arrays), else 0; NULL counts 0."""
    count = column or next((c for c in ("neg_len", "neg_num") if c in df.columns), None)
    if count is not None:
        return F.coalesce(F.col(count).cast("int"), F.lit(0))
    arrays = next((c for c in ("neg_emb_idx", "neg") if c in df.columns), None)
    return F.lit(0) if arrays is None else F.greatest(F.coalesce(F.size(arrays), F.lit(0)), F.lit(0))


def batch_plan_dynamic(df: DataFrame, key_cols: Sequence[str], per_rank: int, world: int, max_pairs: int | None,
                       max_neg: int | None = None, seed: int = 42, epoch: int = 0,
                       label_group_subsets: Sequence[str] = (), drop_last: bool = True, shuffle_batches: bool = True,
                       neg_len: str | None = None, block_rows: int = 100_000) -> DataFrame:
    """Per task, the next batch's per-rank size shrinks to ``max(1, min(B, P // (1+Kmin)))`` where Kmin is the
    smallest negative count (capped by ``max_neg``) among the next ``B·world`` rows; the batch then takes
    ``size·world`` rows.

    The cut is a sequential scan, made parallel by blocks of ``block_rows`` positions: each block (plus the
    ``B·world - 1`` rows after it) computes where a scan entering at offset 0..B·world-1 leaves it and how many
    batches it starts. ``chain_blocks`` composes these maps on the cluster, and each block then replays its scan
    from the known entry. Only the narrow (task, position, neg_len) columns move. A NULL task is a task.
    ``neg_len`` names the column of negative counts; None takes the first of ``negative_count``'s columns.
    """
    G = per_rank * world
    s = seed + epoch
    keys = [F.col(k) for k in key_cols]
    d = df.withColumn("task", task_key(df, label_group_subsets)).withColumn("_nl", negative_count(df, neg_len))
    d = cut_lineage(hash_row_index(d, ["task"], h(s, "row", *keys), list(key_cols), out="_pos"))
    narrow = d.select("task", "_pos", "_nl")
    sizes = narrow.groupBy("task").agg(F.count(F.lit(1)).alias("_n"))
    own = narrow.withColumn("block", F.floor(F.col("_pos") / block_rows).cast("bigint")).withColumn("_la", F.lit(False))
    look = (narrow.filter((F.col("_pos") % block_rows < G - 1) & (F.col("_pos") >= block_rows))
            .withColumn("block", F.floor(F.col("_pos") / block_rows).cast("bigint") - 1).withColumn("_la", F.lit(True)))
    grp = null_safe_join(own.unionByName(look), sizes, ["task"])  # one row per task on the right
    args = (per_rank, world, max_pairs, max_neg, drop_last)

    def transfer(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos")
        b = int(pdf["block"].iloc[0])
        neg = pdf["_nl"].to_numpy()
        s_eff = int((~pdf["_la"]).sum())
        n_rem = int(pdf["_n"].iloc[0]) - b * block_rows
        exits = _block_map(_batch_lengths(neg, n_rem, *args), s_eff, n_rem, G)
        return pd.DataFrame({"task": [pdf["task"].iloc[0]], "block": [b], "exits": [[e for e, _ in exits]], "starts": [[n for _, n in exits]]})

    maps = grp.groupBy("task", "block").applyInPandas(transfer, "task string, block long, exits array<int>, starts array<long>")
    steps = F.zip_with("exits", "starts", lambda e, n: F.struct(e.alias("exit"), n.alias("n")))
    start_df = chain_blocks(maps.select("task", "block", steps.alias("map")), ["task"]).withColumnRenamed("first", "first_batch")

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos")
        b = int(pdf["block"].iloc[0])
        neg = pdf["_nl"].to_numpy()
        s_eff = int((~pdf["_la"]).sum())
        n_rem = int(pdf["_n"].iloc[0]) - b * block_rows
        starts = _batch_starts(_batch_lengths(neg, n_rem, *args), s_eff, n_rem, int(pdf["entry"].iloc[0]))
        at, rows_in = np.array(starts, dtype=np.int64).reshape(-1, 2).T
        inside = np.arange(rows_in.sum()) - np.repeat(np.cumsum(rows_in) - rows_in, rows_in)
        return pd.DataFrame({"task": pdf["task"].iloc[0], "_pos": b * block_rows + np.repeat(at, rows_in) + inside,
                             "batch_no": int(pdf["first_batch"].iloc[0]) + np.repeat(np.arange(len(at)), rows_in),
                             "row_in_batch": inside.astype(np.int32)})

    tagged = cut_lineage(null_safe_join(grp, start_df, ["task", "block"]).groupBy("task", "block").applyInPandas(
        assign, "task string, _pos long, batch_no long, row_in_batch int"))
    rows = null_safe_join(d, tagged, ["task", "_pos"]).drop("_nl")
    batches = tagged.where("row_in_batch = 0").select("task", "batch_no")
    border = h(s, "batch", F.col("task"), F.col("batch_no")) if shuffle_batches else F.lit(0)
    batches = hash_row_index(batches, [], border, ["task", "batch_no"], out="batch_id")
    return null_safe_join(rows, batches, ["task", "batch_no"]).drop("_pos")
