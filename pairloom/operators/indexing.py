"""Dense row positions without single-task windows.

``hash_row_index``: position inside a group ordered by a 32-bit hash. Every group is cut into
``2**bits`` slices by the hash's top bits, so the order by hash is kept while a hot group (a third
of all rows) is spread over many window tasks; slice offsets come from a table of slice counts
(at most one row per non-empty slice).

``range_row_index``: position under any order, by Spark's range partitioning, a written result with row
numbers, and offsets by partition.

``select_first``: the first n rows of each group by hash, by radix selection.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .._util import as_cols
from ..functions.hashing import HASH_BITS
from ..session import cut_lineage, ensure_checkpoint_dir

DEFAULT_ROWS_PER_SLICE = 2_000_000
MAX_BROADCAST_GROUPS = 100_000


def salt_bits_for(df: DataFrame, group: Sequence[str], rows_per_slice: int = DEFAULT_ROWS_PER_SLICE) -> int:
    """Bits of hash salt so the largest group's slices hold about ``rows_per_slice`` rows."""
    if group:
        biggest = df.groupBy(*group).count().agg(F.max("count")).first()[0]
    else:
        biggest = df.count()
    biggest = biggest or 0
    if biggest <= rows_per_slice:
        return 0
    return min(16, int(math.ceil(math.log2(biggest / rows_per_slice))))


def hash_row_index(
    df: DataFrame,
    group: Sequence[str],
    order_hash: Column | str,
    ties: Sequence[str | Column],
    out: str = "idx",
    bits: int | None = None,
    rows_per_slice: int = DEFAULT_ROWS_PER_SLICE,
) -> DataFrame:
    """0-based ``out`` = position within ``group`` ordered by (``order_hash``, ``ties``).

    ``order_hash`` must lie in ``[0, 2**32)`` (see :func:`pairloom.functions.hashing.h`).
    """
    group = list(group)
    oh = F.col(order_hash) if isinstance(order_hash, str) else order_hash
    d = df.withColumn("__hrioh", oh)
    if bits is None:
        bits = salt_bits_for(d, group, rows_per_slice)
    d = d.withColumn("__hrislice", F.shiftright(F.col("__hrioh"), 32 - bits) if bits else F.lit(0))
    keys = group + ["__hrislice"]
    w = Window.partitionBy(*keys).orderBy(F.col("__hrioh"), *as_cols(ties))
    local = d.withColumn("__hrirn", F.row_number().over(w) - 1)
    if bits == 0:
        return local.withColumn(out, F.col("__hrirn").cast("bigint")).drop("__hrioh", "__hrislice", "__hrirn")
    counts = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("__hrin"))
    before = Window.partitionBy(*group).orderBy("__hrislice").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(*keys, F.coalesce(F.sum("__hrin").over(before), F.lit(0)).alias("__hrioff"))
    joined = null_safe_join(local, offs, keys)
    return joined.withColumn(out, (F.col("__hrirn") + F.col("__hrioff")).cast("bigint")).drop(
        "__hrioh", "__hrislice", "__hrirn", "__hrioff")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where NULL matches NULL; the result has the left table's key columns."""
    names = {k: f"__nsj_{i}" for i, k in enumerate(keys)}
    other = right.select(*[F.col(k).alias(n) for k, n in names.items()], *[c for c in right.columns if c not in names])
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return left.join(other, same, how).drop(*names.values())


def range_row_index(
    df: DataFrame,
    order: Sequence[tuple[str, bool]],
    out: str = "idx",
    group: Sequence[str] = (),
    by_row: bool = False,
) -> DataFrame:
    """0-based position ``out`` under ``order`` = [(column, ascending), ...], NULL first; end with a unique key.

    With ``group``, positions restart at 0 in every group (NULL is a group). The input is written once; Spark's
    range partitioning deals it by (group, order), so a hot group spans many partitions, and each partition
    is sorted and written with its row numbers. A position is the row number plus the counts of the group's earlier
    partitions: one row per (partition, group) pair that occurs. The numbers are read from the written result, so a
    task that runs again finds the rows where they were. Rows alike in all of ``order`` keep one arbitrary order.
    ``by_row`` deals only the keys by range and joins the other columns by row: for orders under which some ranges hold much longer rows.
    """
    group = list(group)
    keys = [F.col(g).asc_nulls_first() for g in group]
    keys += [F.col(c).asc_nulls_first() if asc else F.col(c).desc_nulls_first() for c, asc in order]
    ensure_checkpoint_dir(df.sparkSession)
    rows = kept = df.checkpoint(eager=True)
    if by_row:
        kept = kept.withColumn("__rriid", F.monotonically_increasing_id())
        rows = kept.select("__rriid", *dict.fromkeys([*group, *[c for c, _ in order]]))
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranked = dealt.withColumn("__rrirow", F.monotonically_increasing_id()).checkpoint(eager=True)
    part = F.shiftright("__rrirow", 33)
    runs = ranked.groupBy(part.alias("__rripart"), *group).agg(F.min("__rrirow").alias("__rrifirst"), F.count(F.lit(1)).alias("__rrin"))
    before = Window.partitionBy(*group).orderBy("__rripart").rowsBetween(Window.unboundedPreceding, -1)
    shift = (F.coalesce(F.sum("__rrin").over(before), F.lit(0)) - F.col("__rrifirst")).alias("__rrishift")
    shifts = cut_lineage(runs.select("__rripart", *group, shift))
    if shifts.count() <= MAX_BROADCAST_GROUPS:  # the rows stay where they are; a join by partition would gather a whole one again
        shifts = F.broadcast(shifts)
    joined = null_safe_join(ranked.withColumn("__rripart", part), shifts, ["__rripart", *group])
    placed = joined.withColumn(out, F.col("__rrirow") + F.col("__rrishift")).drop("__rrirow", "__rripart", "__rrishift")
    return kept.drop(out).join(placed.select("__rriid", out), "__rriid").drop("__rriid") if by_row else placed


def _with_cells(d: DataFrame, cells: DataFrame, group: list[str], groups: int) -> DataFrame:
    """``d`` with the columns of its group's row in ``cells`` (NULL where there is none)."""
    if group:
        return null_safe_join(d, F.broadcast(cells) if groups <= MAX_BROADCAST_GROUPS else cells, group, "left")
    row = cells.first() or {}
    return d.withColumns({c: F.lit(row[c] if row else None).cast("long") for c in cells.columns})


def mark_first(df: DataFrame, limits: DataFrame, order_hash: Column, ties: Sequence[str | Column], group: Sequence[str] = (),
               limit: str = "n", out: str = "first", edge_rows: int = 100_000) -> DataFrame:
    """``out``: whether a row is among the first ``limits[limit]`` of its group by (``order_hash`` in ``[0, 2**32)``, ``ties``).

    A radix selection finds the hash where each group's limit lies: rows are counted by the next hash bits of the cell that
    holds it, level by level, until no such cell holds more than ``edge_rows`` rows. Rows outside the cell need a plain comparison,
    only rows of the cell are ranked. So no group is sorted or gathered, whatever its size or limit. ``limits`` has one row
    per group (NULL is a group; without ``group``, one row); groups without a row, or with a limit of 0 or less, have no first rows.
    """
    group = list(group)
    d = df.withColumn("__mfh", order_hash)
    cells = limits.where(F.col(limit) > 0).select(*group, F.lit(0).cast("long").alias("__mflow"), F.col(limit).cast("long").alias("__mfneed"))
    cells, bits = cut_lineage(cells), HASH_BITS
    groups = cells.count() if group else 1
    for step in (12, 12, 8):
        low = bits - step
        inside = _with_cells(d.select(*group, "__mfh"), cells, group, groups).where(F.shiftright("__mfh", bits) == F.shiftright("__mflow", bits))
        counts = inside.groupBy(*group, F.shiftright("__mfh", low).alias("__mfcell")).agg(F.count(F.lit(1)).alias("__mfn"), F.first("__mfneed").alias("__mfneed"))
        w = Window.partitionBy(*group).orderBy("__mfcell")  # at most 4,096 cells a group
        ahead = F.sum("__mfn").over(w) - F.col("__mfn")
        reached = counts.withColumn("__mfneed", F.col("__mfneed") - ahead).where(F.col("__mfneed") > 0)
        # the last cell that is reached holds the limit, or is the last one of a group with fewer rows
        last = reached.groupBy(*group).agg(F.max(F.struct("__mfcell", "__mfneed", "__mfn")).alias("x"))
        cells = cut_lineage(last.select(*group, F.shiftleft("x.__mfcell", low).alias("__mflow"), "x.__mfneed", "x.__mfn"))
        most, bits = cells.agg(F.max("__mfn")).first()[0] or 0, low
        cells = cells.drop("__mfn")
        if most <= edge_rows:
            break
    j = _with_cells(d, cells, group, groups)
    h, low = F.col("__mfh"), F.col("__mflow")
    edge = F.coalesce((h >= low) & (h < low + (1 << bits)), F.lit(False))
    w = Window.partitionBy(*group).orderBy("__mfh", *as_cols(ties))
    ranked = j.where(edge).withColumn(out, F.row_number().over(w) <= F.col("__mfneed"))
    other = j.where(~edge).withColumn(out, F.coalesce(h < low, F.lit(False)))
    return other.unionByName(ranked).drop("__mfh", "__mflow", "__mfneed")


def select_first(df: DataFrame, limits: DataFrame, order_hash: Column, ties: Sequence[str | Column], group: Sequence[str] = (),
                 limit: str = "n", edge_rows: int = 100_000) -> DataFrame:
    """The rows that :func:`mark_first` marks."""
    marked = mark_first(df, limits, order_hash, ties, group, limit, "__sffirst", edge_rows)
    return marked.where("__sffirst").drop("__sffirst")
