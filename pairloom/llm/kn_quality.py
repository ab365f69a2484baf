"""Quality by perplexity under an interpolated modified Kneser-Ney model (operator 10).

Two models of order 5 are trained on all trusted texts (rows that the label table marks as good), but for a fifth of them
(by hash of the id), which only set the thresholds: one over characters and one over the order of words. A document is rejected when either
perplexity is above the quantile of its language's held-out trusted documents; languages with few such documents use the quantile of all.

The word-order model sees what characters don't: plain words that repeat. A word's symbol is the distance to its last occurrence
(0: none within ``REACH`` words), its form (lower case, capital first, capitals, digits, signs) and whether it ends a sentence.

How it runs:

* Documents are sent once to blocks of bounded text size, as compressed batches.
* Both models go through the same steps together; bit 60 of a counted gram (bit 63 of a key) tells them apart.
* Counts: each block counts the distinct 5-grams of its trusted texts; Spark sums them. All lower orders (continuation counts), context
  totals, discounts and interpolated probabilities are joins and aggregates over the n-gram tables.
* Scoring: each block asks for its distinct n-grams and contexts. Requests and model meet in shards of the key space,
  the answers go back to the blocks, and each document's log-probability is a sum over its characters, or words. The model
  is never broadcast or collected; a block's request is bounded by the block.

A character is its code point below 2048 and else one of 2048 classes by hash, so a 5-gram is one 60-bit
integer and lower orders are its low bits. Texts start with four blanks (code 0) and end with an end mark (code 3).

A null or empty text is scored for its end mark alone. A null language is a language of its own. Without any trusted text, nothing is
rejected. Repeated rows are scored each. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mix64, settle, shared_folder, slices, table, utf8_buffer, utf8_size, word_hashes, word_spans
from .line_templates import kept_table

ORDER, BITS = 5, 12
BLOCK_BYTES = 24 << 20
CHUNK_BYTES = 3 << 20
SHARDS = 64
QUANTILE, LEAST = 0.99, 100
CLASSES = 1 << BITS
REACH = 7
WORD_CLASSES = 4 + 16 * (REACH + 1)
WORDS = np.int64(1 << 60)  # marks a counted gram of the word-order model
LOW = [np.int64((1 << BITS * k) - 1) for k in range(ORDER + 1)]


# ---------- blocks of documents ----------

def with_block(df: DataFrame, blocks: int, text: str | None) -> DataFrame:
    """Block by document id; rows without one go by their text."""
    key = F.col("doc_id") if text is None else F.coalesce(F.col("doc_id"), F.xxhash64(F.col(text)))
    return df.withColumn("block", F.pmod(F.xxhash64(key), F.lit(blocks)))


def packed(docs: DataFrame, blocks: int) -> DataFrame:
    """``block, payload``: compressed batches of ``doc_id, lang, text``, one per block and chunk of the input."""

    def run(batches):
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for b in batches:
            _, off = utf8_buffer(b.column(2))
            for i, j in slices(off, 8 << 20):
                part = b.slice(i, j - i)
                block = part.column(3).to_numpy()
                order = np.argsort(block, kind="stable")
                names, first = np.unique(block[order], return_index=True)
                edge = [*first.tolist(), len(order)]
                out = []
                for x, y in zip(edge, edge[1:]):
                    one = part.take(pa.array(order[x:y])).select(["doc_id", "lang", "text"])
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, one.schema, options=options) as w:
                        w.write_batch(one)
                    out.append(sink.getvalue().to_pybytes())
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(out, pa.binary())], names=["block", "payload"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return with_block(rows, blocks, "text").mapInArrow(run, "block long, payload binary")


def chunks(t: pa.Table):
    """The batches of a block, joined or cut to pieces of about one size."""
    waiting, size = [], 0
    for p in t.column("payload"):
        for b in pa.ipc.open_stream(p.as_buffer()):
            waiting.append(b)
            size += b.column(2).nbytes
            if size >= CHUNK_BYTES:
                yield from cut(waiting)
                waiting, size = [], 0
    if waiting:
        yield from cut(waiting)


def cut(batches: list[pa.RecordBatch]):
    for b in pa.Table.from_batches(batches).combine_chunks().to_batches():
        _, off = utf8_buffer(b.column(2))
        for i, j in slices(off, 2 * CHUNK_BYTES):
            yield b.slice(i, j - i)


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 5-gram that ends at each character (and end mark) of the texts, and each text's first place."""
    raw, off = utf8_buffer(texts)
    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    start = lead[off]
    code = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    high = code >= CLASSES // 2
    if high.any():
        code[high] = np.uint64(CLASSES // 2) + (mix64(code[high]) & np.uint64(CLASSES // 2 - 1))
    code[code == 0] = 1
    return windows(code.astype(np.int64), start)


def windows(code: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 5-gram that ends at each symbol (and end mark) of the texts that begin at ``start[:-1]``, and each text's first place."""
    n = len(start) - 1
    size = np.diff(start)
    pad = ORDER - 1
    line = np.zeros(len(code) + n * ORDER, dtype=np.int64)
    line[np.arange(len(code)) + np.repeat(np.arange(n) * ORDER + pad, size)] = code
    line[start[1:] + np.arange(n) * ORDER + pad] = 3
    out = line[pad:].copy()
    for back in range(1, ORDER):
        out |= line[pad - back:len(line) - back] << BITS * back
    asked = np.ones(len(out), dtype=bool)
    first = start[:-1] + np.arange(n) * ORDER  # of each text, in places of out
    asked[(first[1:, None] - 1 - np.arange(pad)[None, :]).reshape(-1)] = False
    return out[asked], start[:-1] + np.arange(n)


UPPER, DIGIT, SIGN = (np.array([test(chr(i)) for i in range(128)] + [False] * 128) for test in (
    str.isupper, str.isdigit, lambda c: " " < c < "\x7f" and not c.isalnum()))


def word_grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Like ``grams``, over the symbols of the words."""
    raw, off = utf8_buffer(texts)
    start, stop, before = word_spans(raw, off)
    if not len(start):
        return windows(np.zeros(0, np.int64), before)
    upper = UPPER[raw]
    latin = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
    upper[:-1] |= latin

    def within(mark: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mark, start, dtype=np.int32)

    last = raw[stop - 1]
    capitals = within(upper)
    form = np.where(capitals == 0, 0, np.where((capitals == 1) & upper[start], 1, 2))
    form[within(SIGN[raw]) > ((last == 46) | (last == 44))] = 4
    form[within(DIGIT[raw]) > 0] = 3
    word, text = word_hashes(raw, start, stop), np.repeat(np.arange(len(off) - 1), np.diff(before))
    back = np.zeros(len(word), np.int64)
    for d in range(REACH, 0, -1):
        back[d:][(word[d:] == word[:-d]) & (text[d:] == text[:-d])] = d
    return windows(4 + 16 * back + 2 * form + (last == 46), before)


def count(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.sort(x)
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[first], np.diff(np.concatenate([first, [len(x)]]))


def add_counts(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key = np.concatenate([a[0], b[0]])
    order = np.argsort(key, kind="stable")
    key, n = key[order], np.concatenate([a[1], b[1]])[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(n, first)


NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64))


# ---------- training ----------

def is_held(doc_id):
    """A fifth of the trusted documents sets thresholds and is not counted."""
    return F.pmod(F.xxhash64(doc_id, F.lit("held")), F.lit(5)) == 0


def trusted_counts(blocks: DataFrame, trusted: DataFrame, n_blocks: int) -> DataFrame:
    """``gram, n`` of all counted trusted documents, for both models. ``trusted``: distinct ``doc_id``."""
    ids = with_block(trusted.where(~is_held(F.col("doc_id"))), n_blocks, None)

    def run(docs: pa.Table, ids: pa.Table) -> pa.Table:
        known, total = ids.column("doc_id"), NONE
        if docs.num_rows and ids.num_rows:
            for b in chunks(docs):
                b = b.filter(pc.is_in(b.column(0), value_set=known.combine_chunks()))
                if b.num_rows:
                    total = add_counts(total, count(np.concatenate([grams(b.column(2))[0], word_grams(b.column(2))[0] | WORDS])))
        return pa.table({"gram": total[0], "n": total[1].astype(np.int64)})

    return blocks.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def marked(gram: Column, k: int) -> Column:
    """The low ``k`` symbols of a counted gram with the mark of its model."""
    return gram.bitwiseAND(F.lit(int(LOW[k] | WORDS)))


def discounts(levels: list[DataFrame]) -> dict[tuple[int, bool], tuple]:
    """For each order and model the three discounts, and the sums that order 1 needs: ten rows reach the driver."""
    rows = None
    for k, df in enumerate(levels, 1):
        one = df.select(F.lit(k).alias("k"), (F.col("gram") >= int(WORDS)).alias("words"), "n")
        rows = one if rows is None else rows.unionByName(one)
    cells = [F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]
    out = {}
    for r in rows.groupBy("k", "words").agg(*cells, F.count_if(F.col("n") >= 3).alias("more"), F.sum("n").alias("total")).collect():
        y = r.n1 / (r.n1 + 2 * r.n2) if r.n1 else 0.5
        n = (r.n1, r.n2, r.n3, r.n4)
        d = [(i + 1) - (i + 2) * y * n[i + 1] / n[i] if n[i] else y * (i + 1) for i in range(3)]
        out[r.k, r.words] = (*[min(max(x, 0.05), i + 0.95) for i, x in enumerate(d)], r.n1, r.n2, r.more, r.total or 0)
    return out


def both_models(top: DataFrame, folder: str) -> DataFrame | None:
    """``key, logp, logbo``: log-probability of every seen n-gram and log back-off weight of every seen context, of both models.

    ``key`` is ``(order + 8 for the words) << 60 | gram``. ``top`` holds the counts of ``trusted_counts``; a lower order counts the distinct symbols to the
    left. Each order's counts and probabilities are written once and read again, so no plan holds more than one order. A context has at most
    ``CLASSES`` symbols after it, which bounds its window.
    """
    levels = [top]
    for k in range(ORDER - 1, 0, -1):
        levels.insert(0, kept_table(levels[0].groupBy(marked(F.col("gram"), k).alias("gram")).agg(F.count("*").alias("n")), folder, f"counts-{k}"))
    d = discounts(levels)
    if not d:
        return None
    words = F.col("gram") >= int(WORDS)

    def of(k, f) -> Column:
        """``f(discounts of order k, classes)`` of the gram's model."""
        return F.when(words, float(f(d[k, True], WORD_CLASSES))).otherwise(float(f(d[k, False], CLASSES)))

    def cut(k):
        return F.when(F.col("n") == 1, of(k, lambda x, _: x[0])).when(F.col("n") == 2, of(k, lambda x, _: x[1])).otherwise(of(k, lambda x, _: x[2]))

    total = of(1, lambda x, _: x[6])
    free = of(1, lambda x, c: (x[0] * x[3] + x[1] * x[4] + x[2] * x[5]) / x[6] / c)
    p = levels[0].select("gram", ((F.col("n") - cut(1)) / total + free).alias("p"))
    tables, none = [(1, p)], F.lit(None).cast("double")
    for k in range(2, ORDER + 1):
        context = F.shiftright(F.col("gram").bitwiseAND(F.lit(int(LOW[k]))), BITS).bitwiseOR(F.col("gram").bitwiseAND(F.lit(int(WORDS))))
        w = Window.partitionBy("context")
        level = levels[k - 1].select("gram", "n", context.alias("context"), marked(F.col("gram"), k - 1).alias("suffix"), cut(k).alias("cut"))
        level = level.withColumns({"total": F.sum("n").over(w), "bo": F.sum("cut").over(w), "head": F.min("gram").over(w) == F.col("gram")}).withColumn("bo", F.col("bo") / F.col("total"))
        lower = p.select(F.col("gram").alias("suffix"), F.col("p").alias("lower"))
        level = level.join(lower, "suffix").select(
            "gram", "context", "head", "bo", ((F.col("n") - F.col("cut")) / F.col("total") + F.col("bo") * F.col("lower")).alias("p"))
        p = kept_table(level, folder, f"model-{k}")
        tables.append((k, p))

    def key(k, gram):
        model = F.when(gram >= int(WORDS), F.lit(k + 8)).otherwise(F.lit(k))
        return F.shiftleft(model.cast("long"), 60).bitwiseOR(gram.bitwiseAND(F.lit(int(LOW[ORDER])))).alias("key")

    both = None
    for k, t in tables:
        rows = t.select(key(k, F.col("gram")), F.log("p").alias("logp"), none.alias("logbo"))
        if k > 1:
            rows = rows.unionByName(t.where("head").select(key(k - 1, F.col("context")), none.alias("logp"), F.log("bo").alias("logbo")))
        both = rows if both is None else both.unionByName(rows)
    return both.groupBy("key").agg(F.max("logp").alias("logp"), F.max("logbo").alias("logbo"))


# ---------- scoring ----------

def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mix64(keys.view(np.uint64)) % np.uint64(shards)).astype(np.int64)


def tag(k: int, x: np.ndarray) -> np.ndarray:
    return x | np.uint64(k << 60).astype(np.int64)


def wanted(*tops: np.ndarray) -> np.ndarray:
    """Sorted keys of all n-grams and contexts that the distinct 5-grams of each model need."""
    out = []
    for mark, top in zip((0, 8), tops):
        for k in range(ORDER, 0, -1):
            low = np.unique(top & LOW[k])
            out.append(tag(k + mark, low))
            if k > 1:
                out.append(tag(k - 1 + mark, np.unique(low >> np.int64(BITS))))
    return np.unique(np.concatenate(out))


def block_grams(docs: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 5-grams of each model."""
    tops = [np.zeros(0, np.int64)] * 2
    for b in chunks(docs):
        tops = [np.union1d(top, find(b.column(2))[0]) for top, find in zip(tops, (grams, word_grams))]
    return tops[0], tops[1]


def squeeze(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), codec="zstd", asbytes=True)


def unsqueeze(data: bytes, n: int, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    flat = np.frombuffer(pa.decompress(data, decompressed_size=n * width, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(flat.reshape(width, n).T).view(dtype).reshape(-1)


def requests(blocks: DataFrame, shards: int) -> DataFrame:
    """``block, shard, n, keys``: each block's wanted keys, sorted, as differences."""

    def run(t: pa.Table) -> pa.Table:
        keys = wanted(*block_grams(t))
        shard = shard_of(keys, shards)
        rows = []
        for s in np.unique(shard).tolist():
            own = keys[shard == s]
            rows.append((s, len(own), squeeze(np.diff(own, prepend=np.int64(0)))))
        return pa.table({"block": pa.array([t.column("block")[0].as_py()] * len(rows), pa.int64()), "shard": pa.array([r[0] for r in rows], pa.int64()),
                         "n": pa.array([r[1] for r in rows], pa.int64()), "keys": pa.array([r[2] for r in rows], pa.binary())})

    return blocks.groupBy("block").applyInArrow(run, "block long, shard long, n long, keys binary")


def sharded(kn: DataFrame, shards: int) -> DataFrame:
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(b.column(0).to_numpy(), shards)), *b.columns], names=["shard", "key", "logp", "logbo"])

    return kn.mapInArrow(run, "shard long, key long, logp double, logbo double")


def answers(asked: DataFrame, kn: DataFrame) -> DataFrame:
    """``block, shard, n, data``: log-probability and back-off of each wanted key (NaN: not in the model)."""

    def run(ask: pa.Table, own: pa.Table) -> pa.Table:
        rows = []
        if ask.num_rows:
            key = own.column("key").to_numpy()
            order = np.argsort(key)
            key = key[order]
            values = [own.column(c).to_numpy().astype(np.float32)[order] for c in ("logp", "logbo")]
            for r in ask.to_pylist():
                keys = np.cumsum(unsqueeze(r["keys"], r["n"], np.int64))
                out = np.full((2, len(keys)), np.nan, dtype=np.float32)
                if len(key):
                    at = np.minimum(np.searchsorted(key, keys), len(key) - 1)
                    hit = key[at] == keys
                    for i in (0, 1):
                        out[i, hit] = values[i][at[hit]]
                rows.append((r["block"], r["shard"], r["n"], squeeze(out.reshape(-1))))
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                        names=["block", "shard", "n", "data"])

    return asked.groupBy("shard").cogroup(kn.groupBy("shard")).applyInArrow(run, "block long, shard long, n long, data binary")


def gram_logs(top: np.ndarray, keys: np.ndarray, logp: np.ndarray, logbo: np.ndarray, classes: int, mark: int) -> np.ndarray:
    """Interpolated log-probability of each distinct 5-gram, from the longest seen n-gram down."""
    def at(k, x):
        return np.searchsorted(keys, tag(k + mark, x))

    value = logp[at(1, top & LOW[1])].astype(np.float64)
    value = np.where(np.isnan(value), -np.log(classes * 16.0), value)
    for k in range(2, ORDER + 1):
        low = top & LOW[k]
        seen = logp[at(k, low)]
        back = logbo[at(k - 1, low >> np.int64(BITS))]
        value = np.where(np.isnan(seen), value + np.where(np.isnan(back), 0.0, back), seen)
    return value


def scores(blocks: DataFrame, answered: DataFrame, shards: int) -> DataFrame:
    """``doc_id, lang, text_hash, n_symbols, log_prob, n_words, order_log_prob`` of every document (both counts with the end mark)."""
    schema = "doc_id long, lang string, text string, n_symbols long, log_prob double, n_words long, order_log_prob double"
    empty = pa.schema([(n, pa.type_for_alias(t)) for n, t in (x.split() for x in schema.replace("long", "int64").split(", "))])

    def run(docs: pa.Table, got: pa.Table) -> pa.Table:
        out = []
        if docs.num_rows:
            tops = block_grams(docs)
            keys = wanted(*tops)
            shard = shard_of(keys, shards)
            logp, logbo = np.full(len(keys), np.nan, np.float32), np.full(len(keys), np.nan, np.float32)
            for r in got.to_pylist():
                own = shard == r["shard"]
                logp[own], logbo[own] = unsqueeze(r["data"], 2 * r["n"], np.float32).reshape(2, -1)
            values = [gram_logs(top, keys, logp, logbo, classes, mark) for top, classes, mark in zip(tops, (CLASSES, WORD_CLASSES), (0, 8))]
            for b in chunks(docs):
                columns = [b.column(0), b.column(1), b.column(2)]
                for find, top, value in zip((grams, word_grams), tops, values):
                    g, first = find(b.column(2))
                    place = pc.index_in(pa.array(g), value_set=pa.array(top)).to_numpy(zero_copy_only=False)
                    columns += [pa.array(np.diff(np.concatenate([first, [len(g)]])).astype(np.int64)), pa.array(np.add.reduceat(value[place], first))]
                out.append(pa.table(columns, names=empty.names))
        return pa.concat_tables(out) if out else empty.empty_table()

    rows = blocks.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(run, schema)
    return rows.select("doc_id", "lang", F.xxhash64("text").alias("text_hash"), "n_symbols", "log_prob", "n_words", "order_log_prob")


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of finished steps, which it does when the driver collects garbage."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def perplexities(docs: DataFrame, trusted: DataFrame) -> DataFrame | None:
    """``doc_id, lang, text_hash, n_symbols, perplexity, n_words, order_perplexity`` of every document; None without trusted text."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(utf8_size("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // BLOCK_BYTES))
    shards = SHARDS * max(1, -(-n_blocks // 2048))
    folder = shared_folder(spark, "kn")
    kn = both_models(kept_table(trusted_counts(packed(docs, n_blocks), trusted, n_blocks), folder, "counts-5"), folder)
    if kn is None:
        return None
    kn = settle(sharded(kn, shards))
    release(spark)
    blocks = packed(docs, n_blocks)
    found = settle(scores(blocks, answers(requests(blocks, shards), kn), shards))
    release(spark)
    return found.withColumn("perplexity", F.exp(-F.col("log_prob") / F.col("n_symbols"))).withColumn("order_perplexity", F.exp(-F.col("order_log_prob") / F.col("n_words")))


def judge(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, least: int = LEAST) -> DataFrame:
    """``doc_id, lang, text_hash, n_symbols, perplexity, threshold, order_perplexity, order_threshold, keep`` for every document.

    ``labels`` has ``doc_id, quality``; a document is trusted when a label of its id has quality 1.
    """
    trusted = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    found = perplexities(docs, trusted)
    if found is None:
        empty = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.xxhash64("text").alias("text_hash"))
        unknown = [F.lit(None).cast("double").alias(c) for c in ("perplexity", "threshold", "order_perplexity", "order_threshold")]
        return empty.select("*", F.lit(None).cast("long").alias("n_symbols"), *unknown, F.lit(True).alias("keep"))
    held = found.join(trusted.where(is_held(F.col("doc_id"))), "doc_id", "left_semi")
    cuts = [F.percentile_approx(c, F.lit(quantile), F.lit(10000)).alias(f"{c}_cut") for c in ("perplexity", "order_perplexity")]
    by_lang = held.groupBy("lang").agg(*cuts, F.count("*").alias("seen"))
    overall = held.agg(*cuts).first()
    lang = by_lang.withColumnRenamed("lang", "held_lang")
    judged, keep = found.join(lang, F.col("lang").eqNullSafe(F.col("held_lang")), "left"), F.lit(True)
    for c, limit in (("perplexity", "threshold"), ("order_perplexity", "order_threshold")):
        judged = judged.withColumn(limit, F.when(F.col("seen") >= least, F.col(f"{c}_cut")).otherwise(F.lit(overall[f"{c}_cut"]).cast("double")))
        keep = keep & (F.col(limit).isNull() | (F.col(c) <= F.col(limit)))
    return judged.select("doc_id", "lang", "text_hash", "n_symbols", "perplexity", "threshold", "order_perplexity", "order_threshold", keep.alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their columns."""
    out = judge(docs, labels).where(~F.col("keep")).select("doc_id", "text_hash").distinct()
    bad = out.select(F.col("doc_id").alias("__bad_id"), F.col("text_hash").alias("__bad_hash"))
    names = {c: f"__own_{i}" for i, c in enumerate(docs.columns)}
    own = docs.select(*[docs[c].alias(n) for c, n in names.items()])
    same = F.col(names["doc_id"]).cast("long").eqNullSafe(F.col("__bad_id")) & (F.xxhash64(names["text"]) == F.col("__bad_hash"))
    return own.join(bad, same, "left_anti").select(*[F.col(n).alias(c) for c, n in names.items()])


def op10_kn_quality(spark, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return judge(table(spark, sf_dir, "documents"), labels).drop("text_hash")
