"""Texts kept once, outside of the rows: rows carry handles, and the last step reads the texts that its rows show.

Where a result shows a text in many rows, a shuffle keeps each copy on disk until the result is written. A :class:`TextStore` packs
each text once into flat files in the shared checkpoint folder (a file per task attempt, named by its id, so a task that runs
again or twice writes a file of its own); a handle is the text's address there. ``get`` reads the texts of a bounded number of bytes
at a time: addresses in the order of the files, each one once, neighbours in one read.

The folder must be in a file system that PyArrow opens (local, HDFS, S3, GCS, Azure). Where it is not, a handle is the packed text itself.
As with checkpoints, the files stay until the folder is removed.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from ..session import ensure_checkpoint_dir

#: file, offset, packed bytes, bytes; a text that packing does not shorten is kept as it is
ADDRESS = StructType([StructField("f", LongType()), StructField("o", LongType()), StructField("n", IntegerType()), StructField("s", IntegerType())])
READ_BYTES = 8 << 20  # packed bytes that a task holds
SHOW_BYTES = 4 << 20  # bytes of texts in a batch of rows
GAP_BYTES = 16 << 10  # texts this near to each other are read together
RUN_BITS = 20  # texts read together begin in one megabyte of a file
TASK_BYTES = 32 << 20  # bytes of texts in the rows of a task
MAX_TASKS = 100_000


@F.pandas_udf(BinaryType())
def packed(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else zlib.compress(x.encode("utf-8", "surrogatepass")))


UNPACK_ROWS = 256  # rows whose texts are unpacked at a time


def unpacked(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` with its packed ``columns`` (name to ``string`` or ``array<string>``) as texts."""
    names = df.columns

    def text(x):
        return None if x is None else zlib.decompress(x).decode("utf-8", "surrogatepass")

    def run(batches):
        for b in batches:
            for low in range(0, b.num_rows, UNPACK_ROWS):
                part = b.slice(low, UNPACK_ROWS)
                out = []
                for n, c in zip(names, part.columns):
                    if columns.get(n) == "string":
                        c = pa.array([text(x) for x in c.to_pylist()], pa.string())
                    elif n in columns:
                        c = pa.array([None if x is None else [text(t) for t in x] for x in c.to_pylist()], pa.list_(pa.string()))
                    out.append(c)
                yield pa.RecordBatch.from_arrays(out, names=names)

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {columns.get(f.name, f.dataType.simpleString())}" for f in df.schema.fields))


def open_folder(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def cuts(sizes: np.ndarray, most: int):
    """Row ranges of about ``most`` bytes together (a longer row is a range of its own)."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    start, n = 0, len(sizes)
    while start < n:
        stop = int(np.searchsorted(ends, ends[start] + most, side="right")) - 1
        stop = min(max(stop, start + 1), n)
        yield start, stop
        start = stop


def addresses(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's addresses as columns f, o, n, s of an array (-1 for a NULL text), and the first one of each row, then their number."""
    rows = len(column)
    if pa.types.is_struct(column.type):
        first, values = np.arange(rows + 1), column
    else:
        first = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))])
        values = column.flatten()
    fields = [pc.fill_null(x, -1).to_numpy(zero_copy_only=False).astype(np.int64) for x in values.flatten()]
    return np.column_stack(fields), first.astype(np.int64)


def read_at(fs, root: str, at: np.ndarray) -> list[bytes | None]:
    """The packed texts at the addresses ``at``."""
    out: list[bytes | None] = [None] * len(at)
    order = np.lexsort((at[:, 1], at[:, 0]))
    order = order[at[order, 2] >= 0]
    for part in np.split(order, np.flatnonzero(np.diff(at[order, 0])) + 1):
        if not len(part):
            continue
        starts, ends = at[part, 1], at[part, 1] + at[part, 2]
        far = starts[1:] > np.maximum.accumulate(ends)[:-1] + GAP_BYTES
        far = np.flatnonzero(far | (np.diff(starts >> RUN_BITS) > 0)) + 1
        with fs.open_input_file(f"{root}/{at[part[0], 0]}") as f:
            for run in np.split(np.arange(len(part)), far):
                low = int(starts[run[0]])
                block = f.read_at(int(ends[run].max()) - low, low)
                last, text = -1, b""
                for k in run.tolist():
                    if starts[k] != last or len(text) != ends[k] - last:
                        last = int(starts[k])
                        text = block[last - low:int(ends[k]) - low]
                    out[part[k]] = text
    return out


class TextStore:
    def __init__(self, spark: SparkSession):
        folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/texts-{uuid.uuid4().hex}"
        try:
            open_folder(folder)
        except (pa.ArrowException, OSError, ImportError):
            folder = None
        self.folder = folder

    def put(self, df: DataFrame, columns: list[str]) -> DataFrame:
        """``df`` with handles in place of its text ``columns``. Each run of this plan writes the texts, so the result must be checkpointed."""
        if self.folder is None:
            return df.withColumns({c: packed(F.col(c)) for c in columns})
        names, folder = df.columns, self.folder

        def run(batches):
            name, (fs, root) = TaskContext.get().taskAttemptId(), open_folder(folder)
            codec, out, end = pa.Codec("zstd"), None, 0
            try:
                for b in batches:
                    cols = list(b.columns)
                    for c in columns:
                        k = names.index(c)
                        at = []
                        for x in cols[k].cast(pa.binary()):
                            x = x.as_buffer()  # the batch's own bytes
                            if x is None:
                                at.append(None)
                                continue
                            y = codec.compress(x)
                            y = y if len(y) < len(x) else x
                            if out is None:
                                fs.create_dir(root, recursive=True)
                                out = fs.open_output_stream(f"{root}/{name}")
                            out.write(y)
                            at.append((name, end, len(y), len(x)))
                            end += len(y)
                        kind = pa.struct([("f", pa.int64()), ("o", pa.int64()), ("n", pa.int32()), ("s", pa.int32())])
                        cols[k] = pa.array([None if x is None else dict(zip("fons", x)) for x in at], kind)
                    yield pa.RecordBatch.from_arrays(cols, names=names)
            finally:
                if out is not None:
                    out.close()

        return df.mapInArrow(run, StructType([StructField(f.name, ADDRESS if f.name in columns else f.dataType) for f in df.schema.fields]))

    def size(self, column: str) -> Column:
        """Bytes of the text behind a handle (packed ones, where the handle is the text)."""
        return (F.octet_length(F.col(column)) if self.folder is None else F.col(column)["s"]).cast("long")

    def get(self, df: DataFrame, columns: list[str]) -> DataFrame:
        """``df`` with texts in place of the handles, or arrays of handles, in its ``columns``."""
        lists = {f.name for f in df.schema.fields if f.name in columns and isinstance(f.dataType, ArrayType)}
        if self.folder is None:
            return unpacked(df, {c: "array<string>" if c in lists else "string" for c in columns})
        names, folder = df.columns, self.folder

        def run(batches):
            (fs, root), codec = open_folder(folder), pa.Codec("zstd")

            def strings(texts: list, at: np.ndarray) -> pa.Array:
                out = [x if x is None or len(x) == s else codec.decompress(x, decompressed_size=s, asbytes=True) for x, s in zip(texts, at[:, 3].tolist())]
                return pa.array(out, pa.binary()).view(pa.string())  # as they were written: nothing is decoded

            for b in batches:
                found = {c: addresses(b.column(names.index(c))) for c in columns}
                total = np.zeros((b.num_rows, 2), np.int64)  # of a row: packed bytes, bytes
                for at, first in found.values():
                    ends = np.vstack([np.zeros((1, 2), np.int64), np.cumsum(np.maximum(at[:, 2:], 0), axis=0)])
                    total += ends[first[1:]] - ends[first[:-1]]
                for i, j in cuts(total[:, 0], READ_BYTES):
                    here = [at[first[i]:first[j]] for at, first in found.values()]
                    texts = read_at(fs, root, np.concatenate(here))
                    base = dict(zip(columns, np.cumsum([0, *map(len, here)]).tolist()))
                    for x, y in cuts(total[i:j, 1], SHOW_BYTES):
                        part = b.slice(i + x, y - x)
                        cols = list(part.columns)
                        for c in columns:
                            k, (at, first) = names.index(c), found[c]
                            low, high = int(first[i + x]), int(first[i + y])
                            shift = base[c] - int(first[i])
                            shown = strings(texts[low + shift:high + shift], at[low:high])
                            if c in lists:
                                mask = cols[k].is_null() if cols[k].null_count else None
                                shown = pa.ListArray.from_arrays(pa.array(first[i + x:i + y + 1] - low, pa.int32()), shown, mask=mask)
                            cols[k] = shown
                        yield pa.RecordBatch.from_arrays(cols, names=names)

        kind = {c: ArrayType(StringType()) if c in lists else StringType() for c in columns}
        return df.mapInArrow(run, StructType([StructField(f.name, kind.get(f.name, f.dataType)) for f in df.schema.fields]))


def tasks_for(size: int) -> int:
    """Tasks for rows that show ``size`` bytes of texts: rows with handles are too small for adaptive execution to see how much they show."""
    return max(1, min(MAX_TASKS, -(-int(size) // TASK_BYTES)))
