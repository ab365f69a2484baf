"""Phrase collocations by vertical partitioning of a depth-truncated suffix tree (operator 11).

All phrases of 1 to ``DEPTH`` words with at least ``LEAST`` occurrences are counted in subtrees that are built independently of each other:

1. Words are counted per language. The counts size the prefixes: a prefix is a first word, and a first word with more occurrences than the memory budget
   is extended by one word (and again, up to the whole depth), so each prefix fits the budget. Only the extended prefixes reach the driver; the sum of all counts
   bounds their number by ``MOST_EXTENDED`` a level.
2. Prefixes are dealt to ``CELLS`` cells of their hash space. Neighbouring cells are joined into groups as long as their exact counts fit the budget. The group
   edges are at most ``CELLS`` numbers.
3. Each task cuts its texts into suffixes of up to ``DEPTH`` words within a piece, counts equal ones, and sends them to the group of their prefix.
   Passages that many documents share are summed before they are shuffled.
4. A group is one subtree: its sorted suffixes are the leaves, a node is a run of equal first words, and its count is the sum of its leaves. Nodes below
   ``LEAST`` are left out; those above an extended prefix are parts and are summed over the groups.

Phrases, cuts, containment and ranks are joins over the counted phrases. Scores use decimal arithmetic of 38 digits. A language's first ``top`` phrases are
taken in rounds over ever fewer slices, so no task sorts a whole language.

Words are runs of bytes other than blank and tab inside pieces; pieces end at ``.,;:!?`` and at 0x0A-0x0D; A-Z are lower-cased. A null or empty text has no words; a null
language is ``und`` (with the documents whose language is that name). Repeated rows count each. Texts of any length are read whole (and worked off in
parts that end with a piece). Equal scores are ordered by occurrences and then by phrase, which is unique. Other columns, ids included, are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64, shared_folder, slices, table, utf8_buffer, word_hashes, word_spans
from .line_templates import kept_table

DEPTH, LEAST, TOP, COVER = 4, 30, 2000, (80, 100)
BUDGET = 2_000_000
CELLS, MOST_EXTENDED = 1 << 16, 1 << 16
CHUNK_BYTES = 4 << 20
SLICE_ROWS = 100_000
ENDS = np.isin(np.arange(256), [ord(c) for c in ".,;:!?"] + list(range(0x0A, 0x0E)))
BREAKS = ENDS | np.isin(np.arange(256), [0x20, 0x09])
STEP = np.uint64(0x9E3779B97F4A7C15)


# ---------- words of a batch ----------

class Words:
    """Words of some texts: ``code`` (hash of language and word), ``start`` and ``stop`` in ``raw``, ``lang`` (place of the language) and ``left``:
    how many words follow in the piece, itself included."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lang: np.ndarray, seeds: np.ndarray):
        self.raw = raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
        letter = ~BREAKS[raw]
        self.start, self.stop, first = word_spans(raw, offsets, letter)
        self.lang = np.repeat(lang, np.diff(first))
        self.code = mix64(word_hashes(raw, self.start, self.stop, letter) + seeds[self.lang]) | np.uint64(1)  # 0 marks the end of a piece
        ends = np.concatenate([[0], np.cumsum(ENDS[raw])])
        piece = ends[self.start]  # ends before the word
        n = len(self.start)
        edge = np.ones(n + 1, dtype=bool)
        edge[1:n] = piece[1:] != piece[:-1]
        edge[first[:-1][np.diff(first) > 0]] = True
        last = np.flatnonzero(edge[1:]) + 1  # one past the end of each piece
        self.left = last[np.searchsorted(last, np.arange(n), side="right")] - np.arange(n) if n else np.zeros(0, np.int64)

    def suffixes(self, depth: int) -> np.ndarray:
        """One column per word of the suffix that starts at each word."""
        n = len(self.code)
        padded = np.concatenate([self.code, np.zeros(depth, np.uint64)])
        out = np.zeros((depth, n), np.uint64)
        for k in range(depth):
            out[k] = np.where(self.left > k, padded[k:k + n], np.uint64(0))
        return out


def parts(raw: np.ndarray, offsets: np.ndarray, most: int):
    """Row ranges of about ``most`` bytes; a longer text is cut behind ends of pieces where it has some."""
    for i, j in slices(offsets, most):
        if j - i > 1 or offsets[j] - offsets[i] <= most:
            yield i, j, raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
            continue
        one, at = raw[offsets[i]:offsets[j]], 0
        cuts = np.flatnonzero(ENDS[one]) + 1
        while at < len(one):
            near = cuts[(cuts > at + most // 2) & (cuts <= at + most)] if len(one) - at > most else cuts[:0]
            later = cuts[cuts > at + most]
            stop = int(near[-1]) if len(near) else int(later[0]) if len(one) - at > most and len(later) else len(one)
            yield i, j, one[at:stop], np.array([0, stop - at])
            at = stop


def batches_of_words(batches):
    """``Words`` and the names of their languages for each part of the rows ``lang, text``."""
    for b in batches:
        names = pa.chunked_array([b.column(0)]).combine_chunks().dictionary_encode()
        kinds = names.dictionary.to_pylist()
        lang = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        flat = [k.encode() for k in kinds]
        seeds = word_hashes(np.frombuffer(b"".join(flat), np.uint8), *spans(flat), np.ones(sum(map(len, flat)), bool)) * STEP if flat else np.zeros(0, np.uint64)
        raw, off = utf8_buffer(b.column(1))
        for i, j, part, places in parts(raw, off, CHUNK_BYTES):
            w = Words(part, places, lang[i:j], seeds)
            if len(w.code):
                yield w, kinds


def spans(names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    stop = np.cumsum([len(x) for x in names])
    return stop - np.array([len(x) for x in names]), stop


def texts_of(docs: DataFrame, lang: str, text: str) -> DataFrame:
    code = F.coalesce(F.col(lang).cast("string"), F.lit("und"))
    return docs.where(F.col(text).isNotNull()).select(F.when(code == "", "\x00").otherwise(code).alias("lang"), F.col(text).cast("string").alias("text"))


# ---------- prefixes and groups ----------

def word_counts(texts: DataFrame) -> DataFrame:
    """``code, lang, word, n`` of every word."""
    def run(batches):
        for w, kinds in batches_of_words(batches):
            code, first, n = np.unique(w.code, return_index=True, return_counts=True)
            data = w.raw.tobytes()
            words = [data[x:y] for x, y in zip(w.start[first].tolist(), w.stop[first].tolist())]
            lang = pa.array(kinds, pa.string()).take(pa.array(w.lang[first]))
            yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), lang, pa.array(words, pa.binary()).cast(pa.string()), pa.array(n)],
                                             names=["code", "lang", "word", "n"])

    found = texts.mapInArrow(run, "code long, lang string, word string, n long")
    return found.groupBy("code").agg(F.first("lang").alias("lang"), F.first("word").alias("word"), F.sum("n").alias("n"))


def longer(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix64(prefix * STEP + word)


def extend(suffix: np.ndarray, extended: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Prefix of each suffix and its number of words. ``extended[k]``: sorted prefixes of ``k + 1`` words that go on by one more."""
    prefix, size = suffix[0].copy(), np.ones(suffix.shape[1], dtype=np.int64)
    for k, known in enumerate(extended):
        if len(known):
            at = np.minimum(np.searchsorted(known, prefix), len(known) - 1)
            more = (size == k + 1) & (known[at] == prefix)
            prefix[more] = longer(prefix[more], suffix[k + 1][more])
            size[more] += 1
    return prefix, size


def prefix_counts(texts: DataFrame, extended: list[np.ndarray]) -> DataFrame:
    """``code, n`` of the prefixes that the last level of ``extended`` goes on to."""
    depth = len(extended) + 1

    def run(batches):
        for w, _ in batches_of_words(batches):
            prefix, size = extend(w.suffixes(depth), extended)
            code, n = np.unique(prefix[size == depth], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(n)], names=["code", "n"])

    return texts.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def cell_of(prefix: np.ndarray) -> np.ndarray:
    return (mix64(prefix) >> np.uint64(48)).astype(np.int64)


def cell_counts(prefixes: DataFrame) -> np.ndarray:
    """Occurrences in each cell: at most ``CELLS`` rows reach the driver."""
    def run(batches):
        for b in batches:
            total = np.bincount(cell_of(b.column(0).to_numpy().view(np.uint64)), weights=b.column(1).to_numpy(), minlength=CELLS)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], names=["cell", "n"])

    out = np.zeros(CELLS, np.int64)
    for r in prefixes.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out


def group_edges(cells: np.ndarray, budget: int) -> np.ndarray:
    """First cell of each group: cells join the group before them as long as it stays within the budget."""
    edges, size = [0], 0
    for i, n in enumerate(cells.tolist()):
        if size and size + n > budget:
            edges.append(i)
            size = 0
        size += n
    return np.array(edges)


def vertical_groups(texts: DataFrame, words: DataFrame, budget: int, folder: str) -> tuple[list[np.ndarray], np.ndarray]:
    """The extended prefixes of each level and the first cell of each group."""
    total = words.agg(F.sum("n")).first()[0] or 0
    budget = max(budget, -(-total // MOST_EXTENDED))
    level, extended, settled = words.select("code", "n"), [], None
    while len(extended) < DEPTH - 1:
        hot = [r[0] for r in level.where(F.col("n") > budget).select("code").collect()]  # fewer than MOST_EXTENDED by the choice of the budget
        fits = level.where(F.col("n") <= budget) if hot else level
        settled = fits if settled is None else settled.unionByName(fits)
        if not hot:
            break
        extended.append(np.sort(np.array(hot, dtype=np.int64).view(np.uint64)))
        level = kept_table(prefix_counts(texts, extended), folder, f"prefixes-{len(extended) + 1}")
    else:
        settled = settled.unionByName(level)  # whole suffixes are summed before the shuffle, so they need no further cut
    return extended, group_edges(cell_counts(settled), budget)


# ---------- subtrees ----------

def distinct(columns: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns in lexicographic order and the sums of ``n``."""
    order = np.lexsort(columns[::-1])
    columns, n = columns[:, order], n[order]
    fresh = np.ones(columns.shape[1], dtype=bool)
    fresh[1:] = (columns[:, 1:] != columns[:, :-1]).any(axis=0)
    at = np.flatnonzero(fresh)
    return columns[:, at], np.add.reduceat(n, at) if len(at) else n


def squeeze(x: np.ndarray) -> bytes:
    width = x.dtype.itemsize
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, width).T).tobytes(), codec="zstd", asbytes=True)


def unsqueeze(data: bytes, n: int, dtype: str) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    flat = np.frombuffer(pa.decompress(data, decompressed_size=n * width, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(flat.reshape(width, n).T).view(dtype).reshape(-1)


def leaves(texts: DataFrame, extended: list[np.ndarray], edges: np.ndarray) -> DataFrame:
    """``part, words, suffixes, dictionary, places, counts``: for each task's part of the texts and each group the distinct suffixes with their counts.

    ``dictionary`` holds the group's distinct words, ``places`` the suffixes as places in it, sorted."""
    def send(held):
        suffix, n = distinct(np.concatenate([x for x, _ in held], axis=1), np.concatenate([x for _, x in held])) if len(held) > 1 else held[0]
        group = np.searchsorted(edges, cell_of(extend(suffix, extended)[0]), side="right") - 1
        order = np.argsort(group, kind="stable")
        names, first = np.unique(group[order], return_index=True)
        rows = []
        for g, x, y in zip(names.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]):
            own = order[x:y]
            known, at = np.unique(suffix[:, own], return_inverse=True)
            rows.append((g, len(known), y - x, squeeze(known), squeeze(at.reshape(-1).astype("<u4")), squeeze(n[own].astype("<u4"))))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["part", "words", "suffixes", "dictionary", "places", "counts"])

    def run(batches):
        held, size = [], 0
        for w, _ in batches_of_words(batches):
            held.append(distinct(w.suffixes(DEPTH), np.ones(len(w.code), np.int64)))
            size += held[-1][0].shape[1]
            if size > BUDGET:
                yield send(held)
                held, size = [], 0
        if held:
            yield send(held)

    return texts.mapInArrow(run, "part long, words long, suffixes long, dictionary binary, places binary, counts binary")


def read_leaves(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct suffixes of some rows of ``leaves`` and their counts."""
    columns = []
    for r in rows:
        known = unsqueeze(r["dictionary"], r["words"], "<u8")
        columns.append(known[unsqueeze(r["places"], DEPTH * r["suffixes"], "<u4").reshape(DEPTH, -1)])
    return distinct(np.concatenate(columns, axis=1), np.concatenate([unsqueeze(r["counts"], r["suffixes"], "<u4").astype(np.int64) for r in rows]))


def tree_counts(suffix: np.ndarray, n: np.ndarray, extended: list[np.ndarray], least: int):
    """For each depth the nodes (columns of ``DEPTH`` words, zero beyond the depth) and their counts, from the sorted leaves of a group."""
    _, size = extend(suffix, extended)
    fresh = np.zeros(suffix.shape[1], dtype=bool)
    fresh[:1] = True
    for k in range(DEPTH):
        fresh[1:] |= suffix[k, 1:] != suffix[k, :-1]
        first = np.flatnonzero(fresh)
        total = np.add.reduceat(n, first)
        # a node above an extended prefix has leaves in other groups too
        keep = (suffix[k, first] != 0) & ((total >= least) | (size[first] > k + 1))
        node = np.zeros((DEPTH, int(keep.sum())), np.uint64)
        node[:k + 1] = suffix[:k + 1, first[keep]]
        yield node, total[keep]


def phrase_counts(parts_: DataFrame, extended: list[np.ndarray], groups: int, least: int) -> DataFrame:
    """``w (array of the words' codes), n`` of all phrases with ``least`` occurrences or more."""
    def run(batches):
        group, waiting, size, held = None, [], 0, None

        def merged():
            new = read_leaves(waiting)
            return new if held is None else distinct(np.concatenate([held[0], new[0]], axis=1), np.concatenate([held[1], new[1]]))

        def out(tree):
            for node, total in tree_counts(*tree, extended, least):
                if node.shape[1]:
                    yield pa.RecordBatch.from_arrays([*[pa.array(x.view(np.int64)) for x in node], pa.array(total)], names=["w1", "w2", "w3", "w4", "n"])

        for r in (r for b in batches for r in b.to_pylist()):
            if r["part"] != group:
                if group is not None:
                    yield from out(merged())
                group, waiting, size, held = r["part"], [], 0, None
            elif size > max(BUDGET // 2, 0 if held is None else held[0].shape[1]):
                held, waiting, size = merged(), [], 0
            waiting.append(r)
            size += r["suffixes"]
        if group is not None:
            yield from out(merged())

    dealt = parts_.repartition(groups, "part").sortWithinPartitions("part")
    found = dealt.mapInArrow(run, "w1 long, w2 long, w3 long, w4 long, n long")
    return found.groupBy("w1", "w2", "w3", "w4").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# ---------- scores ----------

def words_in(w: Column, first: int, size: int) -> list[Column]:
    return [w[first + i] if i < size else F.lit(0).cast("long") for i in range(DEPTH)]


def scored(phrases: DataFrame, folder: str, cover: tuple[int, int]) -> DataFrame:
    """``w1..w4, size, n, l, r, score`` of the candidates that no longer candidate covers."""
    names = [f"w{i + 1}" for i in range(DEPTH)]
    size = sum((F.col(c) != 0).cast("int") for c in names)
    p = phrases.select(*names, F.array(*names).alias("w"), size.alias("size"), "n")

    def key(first: int, many: int) -> Column:
        return F.struct(*[x.alias(c) for x, c in zip(words_in(F.col("w"), first, many), names)])

    cuts, inner = [], []
    for k in range(2, DEPTH + 1):
        for c in range(1, k):
            cuts.append(F.when(F.col("size") == k, F.array(F.struct(F.lit(c).alias("cut"), F.lit(0).alias("side"), key(0, c).alias("part")), F.struct(F.lit(c).alias("cut"), F.lit(1).alias("side"), key(c, k - c).alias("part")))))
        for many in range(2, k):
            inner.append(F.when(F.col("size") == k, F.array(*[key(i, many) for i in range(k - many + 1)])))

    def spread(options: list[Column]) -> Column:
        return F.explode(F.flatten(F.filter(F.array(*options), lambda x: x.isNotNull())))

    candidates = p.where("size > 1")
    rows = candidates.select(*names, "n", spread(cuts).alias("c")).select(*names, "n", "c.cut", "c.side", *[F.col(f"c.part.{c}").alias(f"p_{c}") for c in names])
    totals = phrases.select(*[F.col(c).alias(f"p_{c}") for c in names], F.col("n").alias("part_n"))
    halves = rows.join(totals, [f"p_{c}" for c in names]).groupBy(*names, "cut").agg(
        F.first("n").alias("n"), F.max(F.when(F.col("side") == 0, F.col("part_n"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("part_n"))).alias("r"))
    score = F.expr("CAST((CAST(n AS DECIMAL(20,0)) * CAST(2000000 AS DECIMAL(7,0))) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0))) AS BIGINT)")
    lowest = halves.withColumn("score", score).groupBy(*names).agg(F.first("n").alias("n"), F.min(F.struct("score", "cut", "l", "r")).alias("low"))
    long = candidates.where("size > 2").select("n", spread(inner).alias("s"))
    covering = long.groupBy(*[F.col(f"s.{c}").alias(c) for c in names]).agg(F.max("n").alias("cover"))
    part, whole = cover
    free = F.col("cover").isNull() | (F.col("cover").cast("decimal(20,0)") * whole < F.col("n").cast("decimal(20,0)") * part)
    return lowest.join(covering, names, "left").where(free).select(*names, "n", "low.l", "low.r", "low.score")


def first_rows(rows: DataFrame, by: str, order: list[Column], top: int, folder: str) -> DataFrame:
    """The first ``top`` rows of each ``by`` with their ``rank``, by rounds over ever fewer slices of a bounded size."""
    n, step = rows.count(), 0
    slices_ = -(-n // SLICE_ROWS)
    while slices_ > 1:
        step += 1
        w = Window.partitionBy(by, "slice").orderBy(*order)
        rows = rows.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(slices_))).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).drop("rank", "slice")
        rows = kept_table(rows, folder, f"first-{step}")
        slices_ //= 16
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= top)


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", top: int = TOP, least: int = LEAST, cover: tuple[int, int] = COVER,
                 budget: int = BUDGET) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` collocations."""
    folder = shared_folder(docs.sparkSession, "phrases")
    texts = texts_of(docs, lang, text)
    words = kept_table(word_counts(texts), folder, "words")
    extended, edges = vertical_groups(texts, words, budget, folder)
    phrases = kept_table(phrase_counts(leaves(texts, extended, edges), extended, len(edges), least), folder, "counted")
    found = kept_table(scored(phrases, folder, cover), folder, "scored").withColumnRenamed("n", "a")
    spelled = found.select("a", "l", "r", "score", F.array(*[f"w{i + 1}" for i in range(DEPTH)]).alias("w"), F.monotonically_increasing_id().alias("p"))
    spelled = kept_table(spelled, folder, "spelled")
    letters = spelled.select("p", F.posexplode("w").alias("at", "code")).where("code <> 0").join(words.where(F.col("n") >= least).select("code", "lang", "word"), "code")
    text_of = letters.groupBy("p").agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    rows = kept_table(spelled.drop("w").join(text_of, "p").drop("p"), folder, "rows")
    ranked = first_rows(rows, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], top, folder)
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    out = ranked.join(total, "lang")
    return out.select(F.when(F.col("lang") == "\x00", "").otherwise(F.col("lang")).alias("lang"), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = """
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc, regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') AS p
  FROM documents WHERE text IS NOT NULL),
lines AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM (SELECT lang, unnest(p) AS piece FROM pieces)),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lines WHERE len(w) > 0),
grams AS (SELECT lang, w[i:i + k - 1] AS g FROM starts, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, g, count(*) AS n FROM grams GROUP BY lang, g HAVING count(*) >= 30),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM lines GROUP BY lang),
cuts AS (SELECT lang, g, n AS a, unnest(range(1, len(g))) AS k FROM f WHERE len(g) > 1),
halves AS (SELECT c.lang, c.g, c.a, c.k, x.n AS l, y.n AS r, CAST(CAST(2000000 AS HUGEINT) * c.a // (CAST(x.n AS HUGEINT) + y.n) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.g = c.g[1:c.k] JOIN f y ON y.lang = c.lang AND y.g = c.g[c.k + 1:len(c.g)]),
lowest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS place FROM halves) WHERE place = 1),
spans AS (SELECT lang, g, n, unnest(range(1, len(g))) AS i FROM f WHERE len(g) > 2),
inside AS (SELECT lang, g[i:i + m - 1] AS g, max(n) AS cover FROM spans, (SELECT unnest([2, 3]) AS m) WHERE m < len(g) AND i + m - 1 <= len(g) GROUP BY ALL),
kept AS (SELECT w.* FROM lowest w LEFT JOIN inside s ON s.lang = w.lang AND s.g = w.g WHERE s.cover IS NULL OR 100 * s.cover < 80 * w.a),
named AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score FROM kept),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM named)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score FROM ranked r JOIN total t ON t.lang = r.lang WHERE r.rank <= 2000
"""
