"""Token ids as flat binary files (operator 8).

A folder holds, for each partition, ``<part>.tokens`` (unsigned integers, little endian, 16 bits when the vocabulary
fits, else 32), ``<part>.offsets`` (64-bit: first id of each document inside the part, then the end) and
``<part>.docs`` (64-bit document ids and a null flag per document), and a ``manifest`` table with one row per part. Documents
stand in ascending id order: the parts are ranges of ids, sorted inside. The base of a part is the prefix
sum of the sizes before it, so a document's global start is base + offset. Each attempt of a task writes files of its own name,
and only the names that successful tasks report enter the manifest; a lost executor leaves at most unused files.

Ids come from the tokenizers library; a text is cut at ASCII white space, which the tokenizer drops and no token spans,
and each distinct word is encoded once.

A null or empty text has only the end id. Null document ids come first. Rows with equal ids stand side by side in the
order of the hash of their texts. An empty table gives an empty folder that reads as no rows.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_of_sign, read_spec
from .common import shared_folder, slices, table, utf8_buffer

CHUNK_BYTES = 4 << 20
ENCODE_BYTES = 128 << 10  # texts encoded at a time: their words stay in the processor's cache
KNOWN_WORDS = 600_000  # remembered by one task, at about 200 bytes each
MANIFEST = "part long, name string, dtype string, docs long, tokens long"


#: The normaliser and splitter for which ``WordEncoder`` may encode letters and signs apart.
LETTER_RUNS = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}

#: Latin-1 letters, then visible ASCII signs other than the apostrophe and the bracket that opens added tokens.
LETTERS_SIGNS = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:;=-@\[-`{-~]*)")


class WordEncoder:
    """Ids of white-space-separated words; remembers a bounded number of words and of their parts.

    Most new words are letters followed by signs. Under the rules ``LETTER_RUNS`` these are two pieces that no normalisation or
    lookahead joins, so lower-cased letters and signs go to the library's BPE model one by one and words that differ in case or
    in closing signs share the work. Every other word, and any other tokenizer, goes through the library's whole chain.
    """

    def __init__(self, spec: str, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.kind = dtype[0] + {"u2": "%dH", "u4": "%dI"}[dtype[1:]]
        self.known: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        rules = json.loads(spec)
        self.splits = (all(rules.get(k) == v for k, v in LETTER_RUNS.items())
                       and all(t["content"].startswith("<") for t in rules["added_tokens"]))
        self.signs = str.maketrans({chr(b): sign for sign, b in byte_of_sign().items()})

    def pack(self, ids: list[int]) -> bytes:
        return struct.pack(self.kind % len(ids), *ids)

    def piece(self, text: str) -> bytes:
        """Ids of one piece: the bytes of its UTF-8, written as the vocabulary's signs."""
        found = self.pieces.get(text)
        if found is None:
            if len(self.pieces) >= KNOWN_WORDS:
                self.pieces.clear()
            raw = text if text.isascii() else text.encode().decode("latin-1").translate(self.signs)
            found = self.pieces[text] = self.pack([t.id for t in self.model.tokenize(raw)])
        return found

    def learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        out, rest = {}, []
        for w in words:
            m = LETTERS_SIGNS.fullmatch(w.decode()) if self.splits else None
            if m is None:
                rest.append(w)
                continue
            letters, signs = m.groups()
            out[w] = self.piece(letters.lower()) + self.piece(signs) if signs else self.piece(letters.lower())
        if rest:
            found = self.tokenizer.encode_batch([w.decode() for w in rest], add_special_tokens=False)
            out.update((w, self.pack(e.ids)) for w, e in zip(rest, found))
        return out

    def encode(self, texts: list[bytes], end: bytes) -> list[bytes]:
        words = [t.split() for t in texts]
        flat = list(chain.from_iterable(words))
        ids = list(map(self.known.get, flat))
        new = self.learn({w for w, i in zip(flat, ids) if i is None})
        if new:
            ids = [new[w] if i is None else i for w, i in zip(flat, ids)]
            if len(self.known) + len(new) > KNOWN_WORDS:
                self.known.clear()
            self.known.update(new)
        stops = list(accumulate(map(len, words)))
        return [b"".join(ids[i:j]) + end for i, j in zip([0, *stops], stops)]


def vocabulary_dtype(spec: str, end_id: int) -> str:
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_str(spec).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def open_folder(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, folder: str, spec: str, end_id: int, text: str = "text", key: str = "doc_id") -> None:
    """Encodes ``text``, appends ``end_id`` and writes the files in ascending order of ``key`` (a long)."""
    dtype = vocabulary_dtype(spec, end_id)

    def run(batches):
        encoder, end = WordEncoder(spec, dtype), np.array([end_id], dtype=dtype).tobytes()
        part = TaskContext.get().partitionId()
        name = f"{part:08d}-{uuid.uuid4().hex}"
        fs, root = open_folder(folder)
        fs.create_dir(root, recursive=True)
        width, sizes, n = int(dtype[-1]), [np.zeros(1, np.int64)], 0
        with fs.open_output_stream(f"{root}/{name}.tokens") as tokens, fs.open_output_stream(f"{root}/{name}.docs") as ids:
            for b in batches:
                raw, off = utf8_buffer(b.column(1))
                for i, j in slices(off, ENCODE_BYTES):
                    data, place = raw[off[i]:off[j]].tobytes(), (off[i:j + 1] - off[i]).tolist()
                    out = encoder.encode([data[x:y] for x, y in zip(place, place[1:])], end)
                    tokens.write(b"".join(out))
                    sizes.append(np.fromiter(map(len, out), dtype=np.int64, count=len(out)) // width)
                    key_part = b.column(0).slice(i, j - i)
                    both = np.empty((j - i, 2), dtype="<i8")
                    both[:, 0] = key_part.fill_null(0).to_numpy(zero_copy_only=False)
                    both[:, 1] = key_part.is_null().to_numpy(zero_copy_only=False)
                    ids.write(both.tobytes())
                    n += j - i
        if n:
            offsets = np.cumsum(np.concatenate(sizes)).astype("<u8")
            with fs.open_output_stream(f"{root}/{name}.offsets") as f:
                f.write(offsets.tobytes())
            row = {"part": [part], "name": [name], "dtype": [dtype], "docs": [n], "tokens": [int(offsets[-1])]}
            yield pa.RecordBatch.from_pydict(row)
        else:
            for kind in ("tokens", "docs"):
                fs.delete_file(f"{root}/{name}.{kind}")

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text")]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest with each part's base: one row per part, so the running sum is over a small table."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").withColumn(
        "base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def map_file(fs, path: str, dtype: str) -> np.ndarray:
    """A file as an array: memory-mapped on a file system that the task can map, else read."""
    if fs.type_name == "local":
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.zeros(0, dtype)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=dtype)


def read_token_files(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """``key, start, n_tokens, tokens`` of every document; ``tokens`` holds its ids as little-endian unsigned 32-bit integers."""

    def run(batches):
        fs, root = open_folder(folder)
        for b in batches:
            for r in b.to_pylist():
                at = f"{root}/{r['name']}"
                offsets = map_file(fs, f"{at}.offsets", "<u8").astype(np.int64)
                docs = map_file(fs, f"{at}.docs", "<i8").reshape(-1, 2)
                tokens = map_file(fs, f"{at}.tokens", r["dtype"])
                for i, j in slices(offsets, CHUNK_BYTES // 4):
                    wide = np.asarray(tokens[offsets[i]:offsets[j]], dtype="<u4").tobytes()
                    place = ((offsets[i:j + 1] - offsets[i]) * 4).tolist()
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.array(docs[i:j, 0]), mask=np.array(docs[i:j, 1]) != 0),
                        pa.array(offsets[i:j] + r["base"]), pa.array(np.diff(offsets[i:j + 1])),
                        pa.array([wide[x:y] for x, y in zip(place, place[1:])], pa.binary())],
                        names=["key", "start", "n_tokens", "tokens"])

    parts = read_manifest(spark, folder)
    count = max(1, spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").count())
    spread = parts.repartitionByRange(count, "part")  # a part is a task: the window left all in one, and adaptive execution keeps a given number
    return spread.mapInArrow(run, "key long, start long, n_tokens long, tokens binary").withColumnRenamed("key", key)


def op8_token_files(spark, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), folder, read_spec("word_bpe_49k.json"), end_id=2)
    return read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("tokens").alias("ids_crc32"))
