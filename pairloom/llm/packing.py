"""Variable-capacity best-fit packing (operator 5).

Documents are packed into sequences whose length is one of several permitted capacities. Within a block of rows the pieces come in
falling length. A piece goes into the open bin that it fills best. If none has room, a bin is opened whose capacity has the least cost for each
unit that can be expected in it: ``(capacity + overhead) / min(capacity, units still to pack)``. So large bins are opened while much is left and
small ones at the end. Finally each bin is downsized to the smallest capacity that holds its contents.

A document longer than the largest capacity is cut: full pieces fill bins of their own and the rest is packed like any
other piece. No row is dropped.

Blocks hold a bounded number of pieces by hash of (document, piece, copy), so the packing is independent of the partitions. Rows that are alike
in id and length are counted before they move and numbered as copies, so they spread over all blocks.

A null or empty text is one piece of its end mark alone (length 1). Repeated rows are packed each. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, utf8_size

CAPACITIES = (2048, 4096, 8192, 16384)
OVERHEAD = 64
BLOCK_PIECES = 4096
COPY_RUN = 65536  # copies of one row that are numbered at a time


def best_fit(lengths: list[int], capacities: tuple[int, ...], overhead: int) -> tuple[list[int], list[int], list[int]]:
    """Bin of each piece (given in falling length), its offset there, and the final capacity of each bin."""
    room: list[int] = []  # sorted distinct free room of open bins
    open_bins: dict[int, list[int]] = {}
    left, chosen, offset, size, used = sum(lengths), [], [], [], []
    for n in lengths:
        at = bisect_left(room, n)
        if at < len(room):
            free = room[at]
            b = open_bins[free].pop()
            if not open_bins[free]:
                del open_bins[free]
                room.pop(at)
        else:
            free = min((c for c in capacities if c >= n), key=lambda c: ((c + overhead) / min(c, left), c))
            b = len(size)
            size.append(free)
            used.append(0)
        chosen.append(b)
        offset.append(used[b])
        used[b] += n
        left -= n
        free -= n
        if free:
            if free not in open_bins:
                open_bins[free] = []
                insort(room, free)
            open_bins[free].append(b)
    return chosen, offset, [min(c for c in capacities if c >= u) for u in used]


def pack(docs: DataFrame, length: Column, key: str = "doc_id", capacities: tuple[int, ...] = CAPACITIES,
         overhead: int = OVERHEAD, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """One row per piece: ``key, piece, piece_start, length, bin_id, bin_offset, capacity``."""
    capacities = tuple(sorted(capacities))
    top = capacities[-1]
    rows = docs.select(F.col(key).alias("key"), F.greatest(length.cast("long"), F.lit(1)).alias("n"))
    total = rows.agg(F.sum(F.floor((F.col("n") - 1) / top) + 1)).first()[0] or 0
    zero = F.lit(0).cast("long")
    alike = rows.groupBy("key", "n").agg(F.count(F.lit(1)).alias("copies"))
    runs = alike.withColumn("run", F.explode(F.sequence(zero, F.floor((F.col("copies") - 1) / COPY_RUN))))
    last = F.least(F.lit(COPY_RUN), F.col("copies") - F.col("run") * COPY_RUN) - 1
    copies = runs.withColumn("copy", F.explode(F.sequence(zero, last))).withColumn("copy", F.col("run") * COPY_RUN + F.col("copy"))
    pieces = copies.withColumn("piece", F.explode(F.sequence(zero, F.floor((F.col("n") - 1) / top)))).select(
        "key", "piece", "copy", (F.col("piece") * top).alias("piece_start"), F.least(F.lit(top), F.col("n") - F.col("piece") * top).alias("length"))
    blocks = max(1, -(-total // block_pieces))
    kind = docs.schema[key].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        order = [("length", "descending"), ("key", "ascending"), ("piece", "ascending"), ("copy", "ascending")]
        t = t.sort_by(order)
        block = t.column("block")[0].as_py()
        chosen, offset, size = best_fit(t.column("length").to_pylist(), capacities, overhead)
        place = np.array(chosen, dtype=np.int64)
        return t.select(["key", "piece", "piece_start", "length"]).append_column("bin_id", pa.array(place + (block << 32))).append_column(
            "bin_offset", pa.array(offset, pa.int64())).append_column("capacity", pa.array(np.array(size, dtype=np.int64)[place]))

    schema = f"key {kind}, piece long, piece_start long, length long, bin_id long, bin_offset long, capacity long"
    return pieces.withColumn("block", F.pmod(F.xxhash64("key", "piece", "length", "copy"), F.lit(blocks))).groupBy("block").applyInArrow(
        run, schema).withColumnRenamed("key", key)


def byte_length(text: str = "text") -> Column:
    """Length of a document in a byte vocabulary: its UTF-8 bytes and one end mark."""
    return utf8_size(text) + 1


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), byte_length())
