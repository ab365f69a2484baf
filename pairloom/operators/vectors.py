"""Vector operators: lookups, exact top-k mining, encoding, corpus geometry.

Exact nearest neighbours are exhaustive by definition (the reference uses a flat exact index). Queries and corpus are
dealt into bounded groups, and each pair of groups is one task's work. Inside it the corpus stands in blocks in order of norm: a NumPy
product with a block keeps the best ``k`` so far of each query, and a query skips the blocks that cannot reach its k-th.
A per-query ``row_number() ≤ k`` merges the lists of the groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .indexing import null_safe_join, range_row_index


def lookup_vectors(rows: DataFrame, emb: DataFrame, idx_cols: tuple[str, ...] = ("anc_emb_idx", "pos_emb_idx"),
                   arr_col: str | None = "neg_emb_idx", key: tuple[str, ...] = ("subset", "id")) -> DataFrame:
    """Attach ``<col>_vec`` for scalar index columns and ``neg_vecs`` (in array order): one join on emb_idx for all of a row's indices.

    ``key`` names a row (NULL equals NULL); a row without negatives gets an empty ``neg_vecs``. An index that ``emb`` lacks gives
    NULL, or no vector in ``neg_vecs``. On a table of ``write_vector_store`` the vectors are not shuffled before the join."""
    ask = lambda slot, at, idx: F.struct(F.lit(slot).alias("s"), at.cast("int").alias("p"), idx.cast("bigint").alias("emb_idx"))
    asked = F.array(*[ask(i, F.lit(0), F.col(c)) for i, c in enumerate(idx_cols)]) if idx_cols else None
    if arr_col:
        listed = F.coalesce(F.transform(arr_col, lambda x, p: ask(len(idx_cols), p, x)), F.array().cast("array<struct<s:int,p:int,emb_idx:bigint>>"))
        asked = listed if asked is None else F.concat(asked, listed)
    ex = rows.select(*key, F.explode(asked).alias("_a")).select(*key, "_a.*")
    found = ex.join(emb.select("emb_idx", "embedding"), "emb_idx")
    g = found.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("s", "p", "embedding"))).alias("_s"))
    of = lambda slot: F.transform(F.filter("_s", lambda x: x["s"] == slot), lambda x: x["embedding"])
    out = null_safe_join(rows, g, list(key), "left")
    new = {f"{c}_vec": F.get(of(i), 0) for i, c in enumerate(idx_cols)}
    if arr_col:
        negs = of(len(idx_cols))
        new["neg_vecs"] = F.coalesce(negs, F.array().cast(f"array<{emb.schema['embedding'].dataType.simpleString()}>"))
    return out.withColumns(new).drop("_s")


QUERY_BLOCK = 4096
CORPUS_BLOCK = 16384
GROUP_VALUES = 1 << 22  # vector components on each side of a group: 65,536 vectors of 64
QUERY_GROUPS = 8  # at least, where there are as many query blocks


def _matrix(vecs: pa.ChunkedArray, dim: int | None = None) -> np.ndarray:
    """A list column without nulls as rows of doubles; null components are NaN."""
    vecs = vecs.combine_chunks()
    sizes = pc.list_value_length(vecs).to_numpy(zero_copy_only=False)
    dim = int(sizes[0]) if dim is None else dim
    if (sizes != dim).any():
        raise ValueError("all vectors must have the same size")
    return vecs.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vecs), dim)


def _group_search(metric: str, k: int, step: int, block: int):
    """Group function: left rows are queries (``vec``) and exclusions (``cid``, no vec), right rows the corpus group."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = pa.schema([("qid", left.schema.field("qid").type), ("cid", right.schema.field("cid").type), ("score", pa.float64())])
        asked = pc.is_valid(left.column("vec"))
        q, x = left.filter(asked), left.filter(pc.invert(asked))
        if not q.num_rows or not right.num_rows:
            return names.empty_table()
        by_id = pc.sort_indices(right.column("cid"), null_placement="at_start")
        right = right.take(by_id)  # equal scores: smaller cid first
        cm = _matrix(right.column("vec"))
        qm = _matrix(q.column("vec"), cm.shape[1])
        size, own = (cm * cm).sum(1), np.sqrt((qm * qm).sum(1))
        place = np.argsort(-size, kind="stable")  # blocks in order of norm, NaN last
        cm, size = cm[place], size[place]
        both = pa.chunked_array([*q.column("grp").chunks, *x.column("grp").chunks], left.schema.field("grp").type)
        codes = pd.factorize(both.to_pandas())[0]  # NULL: -1, has no exclusions
        grp, hidden = codes[:q.num_rows], pd.DataFrame({"cid": x.column("cid").to_pandas(), "grp": codes[q.num_rows:]})
        where = np.empty(len(place), dtype=np.int64)
        where[place] = np.arange(len(place))
        hidden = hidden.merge(pd.DataFrame({"cid": right.column("cid").to_pandas(), "col": where}), on="cid") if len(hidden) else hidden.assign(col=0)
        hidden = hidden.sort_values("col")
        hid_col, hid_grp = hidden["col"].to_numpy(dtype=np.int64), hidden["grp"].to_numpy(dtype=np.int64)
        found = []
        for low in range(0, len(qm), step):
            part, norms = qm[low:low + step], own[low:low + step]
            of = np.argsort(grp[low:low + step], kind="stable")
            sorted_grp = grp[low:low + step][of]
            kth = np.full(len(part), np.inf)
            best = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))  # row, cost, place by cid
            for start in range(0, len(cm), block):
                c, sizes = cm[start:start + block], size[start:start + block]
                top, least = np.sqrt(sizes.max()), np.sqrt(sizes.min())
                bound = -norms * top if metric == "ip" else np.maximum(np.maximum(norms - top, least - norms), 0.0)
                # a slack covers rounding; what is not comparable is looked at
                rows = np.flatnonzero(~(bound > kth + 1e-9 * (1 + norms * top + norms)))
                if not len(rows):
                    continue
                some = part if len(rows) == len(part) else part[rows]
                cost = -(some @ c.T)
                if metric == "l2":
                    cost = np.sqrt(np.maximum((some * some).sum(1)[:, None] + sizes[None, :] + 2 * cost, 0.0))
                h = slice(*np.searchsorted(hid_col, [start, start + len(c)]))
                if h.stop > h.start:
                    first = np.searchsorted(sorted_grp, hid_grp[h], side="left")
                    n = np.searchsorted(sorted_grp, hid_grp[h], side="right") - first
                    at = of[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                    col = np.repeat(hid_col[h] - start, n)
                    back = np.full(len(part), -1)
                    back[rows] = np.arange(len(rows))
                    seen = back[at] >= 0
                    cost[back[at[seen]], col[seen]] = np.inf
                edge = kth[rows]
                if np.isinf(edge).any():
                    kk = min(k, len(c))
                    edge = np.minimum(edge, np.partition(cost, kk - 1, axis=1)[:, kk - 1]) if kk == k else edge
                row, col = np.nonzero((cost <= edge[:, None]) & (cost < np.inf))
                if not len(row):
                    continue
                row, value = rows[row], cost[row, col]
                row, value, at = (np.concatenate(z) for z in zip(best, (row, value, place[start + col])))
                order = np.lexsort((at, value, row))
                row, value, at = row[order], value[order], at[order]
                nth = np.arange(len(row)) - np.searchsorted(row, row)
                kth[row[nth == k - 1]] = value[nth == k - 1]
                best = tuple(z[nth < k] for z in (row, value, at))
            found.append((best[0] + low, best[1], best[2]))
        row, value, at = (np.concatenate(z) for z in zip(*found))
        return pa.Table.from_arrays([q.column("qid").take(pa.array(row)), right.column("cid").take(pa.array(at)),
                                     pa.array(-value if metric == "ip" else value)], schema=names)

    return run


def topk_inner_product(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "ip", excluded: DataFrame | None = None,
                       query_block: int = QUERY_BLOCK, corpus_block: int = CORPUS_BLOCK, group_rows: int | None = None) -> DataFrame:
    """Exact top-``k`` per query: queries(qid, vec[, grp]) × corpus(cid, vec) → (qid, cid, score, rank).

    ``metric='ip'`` ranks by inner product (descending); ``'l2'`` by Euclidean distance (ascending). Ties are broken by ``cid``; ids
    are of any type that sorts. ``excluded``(grp, cid) names pairs to leave out before the top-k, by the group of the query.
    Rows without a vector take no part. ``qid`` names one query; a ``cid`` may repeat.

    Both sides are dealt by hash into groups of about ``group_rows`` rows (default: ``GROUP_VALUES`` components), and each query group
    meets each corpus group in one task, so a row moves once for each group of the other side, not for each of its blocks.
    """
    corpus = corpus.select("cid", "vec").where("vec IS NOT NULL")
    n_q = queries.count()
    n_c, dim = corpus.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    most = group_rows or max(1, GROUP_VALUES // max(1, dim or 1))
    q_groups = max(1, min(-(-n_q // query_block), max(QUERY_GROUPS, -(-n_q // most))))
    c_groups = max(1, -(-n_c // most))
    grp = F.col("grp") if "grp" in queries.columns else F.lit(None).cast("string")
    q = queries.where("vec IS NOT NULL").select("qid", "vec", grp.alias("grp"), F.pmod(F.xxhash64("qid"), F.lit(q_groups)).cast("long").alias("qb"))
    c = corpus.withColumn("c_cb", F.pmod(F.xxhash64("cid", "vec"), F.lit(c_groups)).cast("long"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    id_type = c.schema["cid"].dataType
    left = q.select("qb", "qid", "vec", "grp", F.lit(None).cast(id_type).alias("cid"))
    if excluded is not None:
        hidden = excluded.where("cid IS NOT NULL").select("grp", "cid").join(q.select("grp", "qb").distinct(), "grp").distinct()
        none = {"qid": q.schema["qid"].dataType, "vec": q.schema["vec"].dataType}
        rows = hidden.withColumn("cid", F.col("cid").cast(id_type)).withColumns({n: F.lit(None).cast(t) for n, t in none.items()})
        left = left.unionByName(rows.select(*left.columns))
    cells = q_groups * c_groups
    tasks = 1 if cells == 1 else 3 * cells
    left = left.withColumn("cb", every(c_groups)).repartition(tasks, "qb", "cb")
    # both sides come from one table when a corpus is searched with itself: names of their own keep them apart
    right = c.select(every(q_groups).alias("c_qb"), "c_cb", "cid", "vec").toDF("c_qb", "c_cb", "cid", "vec").repartition(tasks, "c_qb", "c_cb")
    step = max(1, min(n_q or 1, max(256, (1 << 22) // corpus_block), 1 << 14))
    schema = f"qid {q.schema['qid'].dataType.simpleString()}, cid {id_type.simpleString()}, score double"
    found = left.groupBy("qb", "cb").cogroup(right.groupBy("c_qb", "c_cb")).applyInArrow(_group_search(metric, k, step, corpus_block), schema)
    order = F.desc("score") if metric == "ip" else F.asc("score")
    w = Window.partitionBy("qid").orderBy(order, F.asc("cid"))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def mine_hard_negatives(queries: DataFrame, corpus: DataFrame, positives: DataFrame, k: int = 10, query_block: int = QUERY_BLOCK,
                        corpus_block: int = CORPUS_BLOCK) -> DataFrame:
    """Per query the ``k`` corpus items of highest inner product that are not positives of the query's
    *text* (positives of every query id sharing the text). queries(qid, qtext, vec), corpus(cid, vec),
    positives(qtext, cid) → (qid, rank, cid, score). Ids are of any type. Positives leave the blocks before the top-k, so a
    query with many of them costs no more than others."""
    excluded = positives.select(F.col("qtext").alias("grp"), "cid").distinct()
    top = topk_inner_product(queries.select("qid", "vec", F.col("qtext").alias("grp")), corpus, k, "ip", excluded, query_block, corpus_block)
    return top.select("qid", F.col("rank").cast("bigint").alias("rank"), "cid", F.round("score", 6).alias("score"))


# ---------------- encoding ----------------

def hashed_ngrams(df: DataFrame, key: Sequence[str], text: str = "text", dim: int = 64, n: int = 3) -> DataFrame:
    """(*key, text) → (*key, embedding): each character n-gram of `` text `` (NULL: empty) adds or subtracts one in a bucket that
    the first 32 bits of its md5 name (bucket: modulo ``dim``; sign: bit 16); the vector is scaled to length one.

    ``key`` names a text (NULL is a key). Texts move once, dealt by key; their grams are summed by (key, bucket) where they are.
    """
    d = df.select(*key, F.concat(F.lit(" "), F.coalesce(F.col(text), F.lit("")), F.lit(" ")).alias("__hnc"))
    # dealt by key first: texts that stand in order of length would leave most characters to a few tasks, and the sums need no other shuffle
    d = d.repartition(*key).select(*key, F.split("__hnc", "").alias("__hnc"))
    # places are exploded and not grams: the rest is plain columns, which are compiled, where a lambda is interpreted
    d = d.select(*key, "__hnc", F.explode(F.sequence(F.lit(0), F.greatest(F.size("__hnc") - n, F.lit(0)))).alias("__hni"))
    d = d.select(*key, F.concat(*[F.coalesce(F.get("__hnc", F.col("__hni") + j), F.lit("")) for j in range(n)]).alias("__hng"))
    d = d.select(*key, F.conv(F.substring(F.md5("__hng"), 1, 8), 16, 10).cast("bigint").alias("__hnd"))
    sign = F.shiftright("__hnd", 16).bitwiseAND(F.lit(1)) * 2 - 1
    cells = d.groupBy(*key, F.pmod("__hnd", F.lit(dim)).cast("int").alias("__hnb")).agg(F.sum(sign).cast("double").alias("__hnv"))
    sums = cells.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("__hnb", "__hnv"))).alias("__hnm"),
                                   F.sqrt(F.sum(F.col("__hnv") * F.col("__hnv"))).alias("__hns"))
    size, value = F.col("__hns"), lambda b: F.coalesce(F.try_element_at("__hnm", b), F.lit(0.0))
    parts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda b: F.when(size > 0, value(b) / size).otherwise(F.lit(0.0)).cast("float"))
    return sums.select(*key, parts.alias("embedding"))


def encode_texts(df: DataFrame, text: str = "text", key: tuple[str, ...] = ("emb_idx",),
                 encoder: Callable[[list[str]], np.ndarray] | None = None, batch_rows: int | dict[str, int] = 64,
                 done: DataFrame | None = None, length_col: str | None = "len", bucket_col: str = "bucket") -> DataFrame:
    """Vector per text: ``hashed_ngrams``, or a user encoder ``list[str] → ndarray`` in Arrow batches.

    For a user encoder, rows are sorted by length inside each partition so batches hold similar lengths (less padding for
    real models); ``batch_rows`` may map length buckets (``bucket_col``, see ``length_buckets``) to their
    own batch size; ``done`` (already encoded keys) is anti-joined first, which makes a rerun resume.
    """
    per_bucket = isinstance(batch_rows, dict)
    extra = [c for c in ([length_col] if length_col else []) + ([bucket_col] if per_bucket else []) if c in df.columns]
    d = df.select(*key, text, *extra)
    if done is not None:
        d = null_safe_join(d, done.select(*key), key, "left_anti")
    if encoder is None:
        return hashed_ngrams(d, key, text)
    if length_col and length_col in d.columns:
        d = d.sortWithinPartitions(F.desc(length_col))
    key_schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in key)

    def batches(pdf: pd.DataFrame):
        if not per_bucket:
            for s in range(0, len(pdf), batch_rows):
                yield pdf.iloc[s:s + batch_rows]
            return
        for b, grp in pdf.groupby(bucket_col, sort=False):
            size = int(batch_rows.get(b, 64))
            for s in range(0, len(grp), size):
                yield grp.iloc[s:s + size]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for part in batches(pdf):
                vecs = encoder(part[text].fillna("").tolist())
                o = part[list(key)].copy()
                o["embedding"] = [v.astype(np.float32) for v in vecs]
                yield o

    return d.mapInPandas(run, f"{key_schema}, embedding array<float>")


# ---------------- geometry ----------------

def iso_score(vectors: DataFrame, col: str = "vec") -> DataFrame:
    """IsoScore of a set of vectors (Rudman et al. 2022): (n, dim, iso_score); 0 for a single point or dimension.

    With C the covariance, its eigenvalues enter only by their sum tr(C) and their norm ‖C‖_F, and the score reduces to
    (tr(C)²/‖C‖_F² − 1) / (dim − 1), so no spectrum is taken. Each partition emits the upper triangle of its partial sums
    (i, j, Σxᵢxⱼ) and (i, -1, Σxᵢ) with its row count; Spark adds them up by key and everything stays distributed.
    """
    def part(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sx, sxx = 0, None, None
        for pdf in it:
            if pdf.empty:
                continue
            x = np.stack(pdf[col].to_numpy()).astype(np.float64)
            n += len(x)
            sx = x.sum(0) if sx is None else sx + x.sum(0)
            sxx = x.T @ x if sxx is None else sxx + x.T @ x
        for i in range(len(sx) if n else 0):
            yield pd.DataFrame({"i": i, "j": np.arange(i - 1, len(sx)), "v": np.concatenate([sx[i:i + 1], sxx[i, i:]]), "n": n}).assign(
                j=lambda d: d["j"].where(d["j"] >= i, -1))

    sums = vectors.select(col).mapInPandas(part, "i long, j long, v double, n long")
    sums = sums.groupBy("i", "j").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    mean = sums.filter(F.col("j") < 0).select("i", (F.col("v") / F.col("n")).alias("m"))
    cells = sums.filter(F.col("j") >= 0).join(mean.withColumnRenamed("m", "mi"), "i")
    cells = cells.join(mean.select(F.col("i").alias("j"), F.col("m").alias("mj")), "j")
    c, own = F.col("v") / F.col("n") - F.col("mi") * F.col("mj"), F.col("i") == F.col("j")
    s = cells.agg(F.max("n").alias("n"), F.count_if(own).alias("dim"), F.sum(F.when(own, c)).alias("t"),
                  F.sum(c * c * F.when(own, 1.0).otherwise(2.0)).alias("f"))
    score = F.when((F.col("dim") > 1) & (F.col("f") > 0), (F.col("t") * F.col("t") / F.col("f") - 1) / (F.col("dim") - 1))
    return s.select(F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.col("dim").cast("long").alias("dim"),
                    F.round(F.coalesce(score, F.lit(0.0)), 6).alias("iso_score"))


def two_nn_dimension(vectors: DataFrame, id_col: str = "vid", col: str = "vec", discard: float = 0.1) -> DataFrame:
    """TwoNN intrinsic dimension (Facco et al. 2017): μ = r₂/r₁ per point, drop r₁ = 0 and the
    largest ``discard`` share, fit −log(1 − i/N) = d·log μᵢ through the origin: d = Σxy / Σx²."""
    v = vectors.select(F.col(id_col).alias("qid"), F.col(col).alias("vec"))
    nn = topk_inner_product(v, v.withColumnRenamed("qid", "cid"), 3, metric="l2")
    nn = nn.filter(F.col("qid") != F.col("cid"))
    w = Window.partitionBy("qid").orderBy("score", "cid")
    nn = nn.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= 2)
    mu = nn.groupBy("qid").agg(F.min_by("score", "_r").alias("r1"), F.max_by("score", "_r").alias("r2"))
    mu = cut_lineage(mu.filter(F.col("r1") > 0).select("qid", (F.col("r2") / F.col("r1")).alias("mu")))
    n_all = mu.count()
    keep = int(n_all * (1 - discard))
    ranked = range_row_index(mu, [("mu", True), ("qid", True)], out="_i").filter(F.col("_i") < keep)
    x = F.log("mu")
    y = -F.log(1 - (F.col("_i") + 1) / F.lit(float(n_all)))
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(x * y) / F.sum(x * x), 6).alias("dimension"))
