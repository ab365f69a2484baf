"""BPE encoding and decoding with forced boundaries (operator 2).

A byte pair that occurs inside no vocabulary token can never lie inside an output token, because every merge
yields a vocabulary token. Such a pair is a certain cut. The text is cut there, each distinct fragment is encoded once by the
tokenizers library, and the fragments' ids are concatenated.

The library also splits words before merging, with a lookahead at white space and with apostrophe endings.
A cut is therefore used only where that splitter gives the same pieces on both sides:

* the right character is ASCII white space: a white-space run is split before its last character at
  most, and both halves keep that rule; or
* the left character is a visible ASCII character and the right one is not an apostrophe: a run of letters,
  digits or signs goes on alike when it starts at the cut.

Strings of added tokens count as vocabulary, so none is ever cut.

Null and empty texts give no ids and decode to the empty text. Repeated rows give repeated results. A text without any cut
is one fragment. Extra columns are ignored.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, table, utf8_buffer

CHUNK_BYTES = 2 << 20
CACHE_FRAGMENTS = 300_000


def read_spec(name: str = "byte_bpe_50k.json", folder: str | None = None) -> str:
    """The tokenizer's JSON (a vocabulary of fixed size, about 1.5 MB), read once and sent with the tasks."""
    if folder is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    else:
        path = os.path.join(folder, name)
    with open(path, encoding="utf-8") as f:
        return f.read()


def byte_of_sign() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def vocabulary(spec: str) -> dict[int, bytes]:
    """Bytes that each id stands for; a token with other signs (an added one) stands for its own UTF-8."""
    j, sign = json.loads(spec), byte_of_sign()
    out = {}
    for token, i in j["model"]["vocab"].items():
        out[i] = bytes(sign[c] for c in token) if all(c in sign for c in token) else token.encode()
    for t in j["added_tokens"]:
        out[t["id"]] = t["content"].encode()
    return out


def certain_cuts(tokens: list[bytes]) -> np.ndarray:
    """For each byte pair ``256 * left + right``: whether a text may be cut there."""
    free = np.ones((256, 256), dtype=bool)
    for t in tokens:
        b = np.frombuffer(t, dtype=np.uint8)
        free[b[:-1], b[1:]] = False
    white = np.zeros(256, dtype=bool)
    white[[9, 10, 11, 12, 13, 32]] = True
    left = np.zeros(256, dtype=bool)
    left[0x21:0x7F] = True
    right = np.ones(256, dtype=bool)
    right[0x80:0xC0] = False  # inside a character
    right[ord("'")] = False
    return (free & (white[None, :] | (left[:, None] & right[None, :]))).reshape(-1)


class FragmentEncoder:
    """Encodes texts in one task; remembers the ids of a bounded number of fragments."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cuts = certain_cuts(list(vocabulary(spec).values()))
        self.known: dict[bytes, bytes] = {}

    def learn(self, fragments: list[bytes]) -> None:
        if len(self.known) + len(fragments) > CACHE_FRAGMENTS:
            self.known.clear()
        found = self.tokenizer.encode_batch([f.decode() for f in fragments], add_special_tokens=False)
        for f, e in zip(fragments, found):
            self.known[f] = np.array(e.ids, dtype="<i4").tobytes()

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and for each text the number of ids before it."""
        pair = raw[:-1].astype(np.uint16) << 8 | raw[1:]
        edge = np.zeros(len(raw) + 1, dtype=bool)
        edge[1:-1] = self.cuts[pair]
        edge[offsets] = True
        at = np.flatnonzero(edge)
        data, place = raw.tobytes(), at.tolist()
        fragments = [data[a:b] for a, b in zip(place, place[1:])]
        distinct = set(fragments)
        new = [f for f in distinct if f not in self.known]
        if len(self.known) + len(new) > CACHE_FRAGMENTS:
            self.known.clear()
            new = list(distinct)
        if new:
            self.learn(new)
        known = self.known
        ids = [known[f] for f in fragments]
        size = np.zeros(len(ids) + 1, dtype=np.int64)
        np.cumsum(np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4, out=size[1:])
        return np.frombuffer(b"".join(ids), dtype="<i4"), size[np.searchsorted(at, offsets)]


def encode_texts(docs: DataFrame, spec: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, ids array<int>`` for every row of ``docs``."""

    def run(batches):
        encoder = FragmentEncoder(spec)
        for b in batches:
            raw, off = utf8_buffer(b.column(1))
            for i, j in slices(off, CHUNK_BYTES):
                ids, start = encoder.encode(raw[off[i]:off[j]], off[i:j + 1] - off[i])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(ids))],
                    names=["key", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode_ids(encoded: DataFrame, spec: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the decoded text: the bytes of all ids joined, then read as UTF-8 (broken sequences become U+FFFD)."""
    names = [c for c in encoded.columns if c != out]

    def run(batches):
        found = vocabulary(spec)
        bytes_of = [found.get(i, b"") for i in range(max(found) + 1)]
        for b in batches:
            col = b.column(b.schema.get_field_index(ids))
            texts = []
            for row in range(len(col)):
                one = col[row].values
                one = [] if one is None else one.to_numpy(zero_copy_only=False).tolist()
                texts.append(b"".join([bytes_of[i] for i in one]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in names], pa.array(texts, pa.string())],
                                             names=[*names, out])

    schema = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in names)
    return encoded.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, f"{schema}, `{out}` string")


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    spec = read_spec("byte_bpe_50k.json")
    both = decode_ids(encode_texts(table(spark, sf_dir, "documents"), spec), spec)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
