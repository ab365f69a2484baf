"""Helpers shared by the operators: table access, the shared folder, hashing of text in NumPy."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder below ``spark.checkpoint.dir`` (the storage that all executors share)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared folder (reliable checkpoint) and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def utf8_size(col: str):
    """UTF-8 bytes of a text column; a null text counts as empty."""
    return F.coalesce(F.octet_length(F.col(col)), F.lit(0)).cast("long")


def utf8_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as one array of UTF-8 bytes and the ``n + 1`` row offsets; null texts are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, off, data = column.buffers()
    off = np.frombuffer(off, dtype=np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def slices(offsets: np.ndarray, most: int):
    """Row ranges whose texts hold about ``most`` bytes together (one longer text is a range of its own)."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        stop = min(max(stop, start + 1), n)
        yield start, stop
        start = stop


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over a 64-bit word."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_spans(raw: np.ndarray, offsets: np.ndarray, letter: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and stop of every word (run of bytes above the space, or where ``letter`` is true) and, for each text, the number of words before it."""
    letter = raw > 32 if letter is None else letter
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = letter
    edge = np.diff(inside)
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    both = cut[letter[cut - 1] & letter[cut]] if len(cut) else cut
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(both):  # a text ends and the next begins without white space between them
        both = np.unique(both)
        start, stop = np.sort(np.concatenate([start, both])), np.sort(np.concatenate([stop, both]))
    return start, stop, np.searchsorted(start, offsets, side="left")


def _letters() -> np.ndarray:
    rows = np.arange(256 * 64, dtype=np.uint64) + np.uint64(1)
    return mix64(rows * np.uint64(0x9E3779B97F4A7C15)).reshape(64, 256)


LETTERS = _letters()


def word_hashes(raw: np.ndarray, start: np.ndarray, stop: np.ndarray, letter: np.ndarray | None = None) -> np.ndarray:
    """64-bit tabulation hash of each word (spans of ``word_spans`` with the same ``letter``): the sum of a table entry per (place, byte)."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = stop - start
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(first, size)
    byte = raw[raw > 32 if letter is None else letter]
    part = LETTERS[place & 63, byte] * (place >> 6 << 1 | 1).astype(np.uint64)
    return mix64(np.add.reduceat(part, first) + size.astype(np.uint64))


def byte_words(raw: np.ndarray, offsets: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (run of bytes that are no ``breaks``, 256 marks) and, for each text, the number of words before it."""
    letter = ~breaks[raw]
    start, stop, first = word_spans(raw, offsets, letter)
    return word_hashes(raw, start, stop, letter), first
