"""Joins that look texts up, attach negatives and map texts to ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import h
from ..session import cut_lineage
from .indexing import null_safe_join, range_row_index, select_first
from .ordering import one_limit
from .textops import normalize_query


def qrels_pairs(qrels: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """qrels(query-id, corpus-id) ⋈ queries(_id, text) ⋈ corpus(_id, title, text) → (query_id, corpus_id, anc, pos).

    Pairs whose ids are missing on either side drop out; pos = ``title + ' ' + text``.
    """
    q = queries.select(F.col("_id").alias("query_id"), F.col("text").alias("anc"))
    c = corpus.select(F.col("_id").alias("corpus_id"), F.concat(F.col("title"), F.lit(" "), F.col("text")).alias("pos"))
    r = qrels.select(F.col("query-id").alias("query_id"), F.col("corpus-id").alias("corpus_id"))
    return r.join(q, "query_id").join(c, "corpus_id").select("query_id", "corpus_id", "anc", "pos")


def positives_by_query(qrels: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query_id → sorted positive ids) and (query text → union of positives over its ids)."""
    r = qrels.select(F.col("query-id").alias("query_id"), F.col("corpus-id").alias("corpus_id"))
    by_id = r.groupBy("query_id").agg(F.array_sort(F.collect_set("corpus_id")).alias("pos_ids"))
    q = queries.select(F.col("_id").alias("query_id"), F.col("text").alias("query"))
    by_text = r.join(q, "query_id").groupBy("query").agg(F.array_sort(F.collect_set("corpus_id")).alias("pos_ids"))
    return by_id, by_text


def assert_unique(df: DataFrame, keys: Sequence[str], what: str) -> None:
    # equal keys have equal hashes: only rows whose hash repeats are compared by their keys, so the keys' texts stay where they are
    hashed = df.select(F.xxhash64(*keys).alias("__auh"), *keys)
    twice = cut_lineage(hashed.groupBy("__auh").count().filter(F.col("count") > 1).select("__auh"))
    if twice.isEmpty():
        return
    dup = hashed.join(twice, "__auh", "left_semi").groupBy(*keys).count().filter(F.col("count") > 1)
    if not dup.isEmpty():
        raise ValueError(f"{what}: join keys {list(keys)} are not unique")


def attach_negatives(base: DataFrame, negs: DataFrame,
                     keys: Sequence[str] = ("anc", "pos", "anc_emb_idx", "pos_emb_idx", "subset"),
                     cols: Sequence[str] = ("neg", "neg_emb_idx"), validate: bool = True) -> DataFrame:
    """One-to-one left join of negatives; rows without a match get empty arrays."""
    keys, cols = list(keys), list(cols)
    if validate:
        assert_unique(base, keys, "base")
        assert_unique(negs, keys, "negatives")
    j = base.join(negs.select(*keys, *cols), keys, "left")
    for c in cols:
        et = negs.schema[c].dataType.simpleString()
        j = j.withColumn(c, F.coalesce(F.col(c), F.array().cast(et)))
    return j


def raw_negatives_by_pair(base: DataFrame, raw: DataFrame, keys: Sequence[str] = ("subset", "anc", "pos")) -> DataFrame:
    """Left join normalised raw rows (anc, pos, neg) on (subset, anc, pos); neg → [neg] or []."""
    keys = list(keys)
    r = raw.filter(F.col("neg").isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_set("neg")).alias("_negs"))
    j = base.join(r, keys, "left")
    return j.withColumn("neg", F.coalesce("_negs", F.array().cast("array<string>"))).drop("_negs")


def raw_negatives_by_shape(base: DataFrame, raw: DataFrame, keys: Sequence[str] = ("subset", "anc", "pos")) -> DataFrame:
    """J3 with the raw files' own lists: ``base`` with ``neg`` as it stands in the source, in order and with repeats.

    ``raw`` has the keys, ``shape`` (``query_pos_neg``: a line's whole list ``neg``; ``list``: a triplet whose items after
    the second are ``neg``; any other shape has no negatives) and ``neg array<string>``. A base row comes once for each different list
    of its pair; without a match or list its ``neg`` is empty. NULL keys match NULL keys.
    """
    keys = list(keys)
    lists = raw.filter(F.col("shape").isin("query_pos_neg", "list")).select(*keys, F.col("neg").alias("_negs")).distinct()
    j = null_safe_join(base.drop("neg"), lists, keys, "left")
    return j.withColumn("neg", F.coalesce("_negs", F.array().cast("array<string>"))).drop("_negs")


def raw_negatives_by_query(base: DataFrame, origin: DataFrame, seed: int = 42, cap: int = 7,
                           query: str = "anc", pos: str = "pos") -> DataFrame:
    """Candidate negatives by normalised query text.

    origin(query, neg[]) lines are normalised, kept only for queries present in ``base`` (semi-join),
    exploded, non-empty and ≠ query, distinct per query; per base pair the texts equal to the pair's
    query or positive are dropped and the first ``cap`` by ``h(seed, query, neg)`` (then text) kept.
    """
    b = base.withColumn("_q", normalize_query(F.col(query)))
    o = origin.select(normalize_query(F.col("query")).alias("_q"), F.explode_outer("neg").alias("_n"))
    o = o.filter((F.length("_n") > 0) & (F.col("_n") != F.col("_q")))
    o = o.join(b.select("_q").distinct(), "_q", "left_semi").distinct()
    # a pair drops at most one more text (its positive), so its top ``cap`` lies in the query's top cap+1:
    # the per-query limit runs map-side before any pair sees a candidate (no pairs × candidates blow-up)
    o = o.withColumn("_h", h(seed, F.col("_q"), F.col("_n")))
    o = o.withColumn("_r0", F.row_number().over(Window.partitionBy("_q").orderBy("_h", "_n"))).filter(F.col("_r0") <= cap + 1)
    cand = b.select("_q", F.col(pos).alias("_p")).distinct().join(o, "_q").filter(F.col("_n") != F.col("_p"))
    w = Window.partitionBy("_q", "_p").orderBy("_h", "_n")
    top = cand.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= cap)
    lists = top.groupBy("_q", "_p").agg(F.array_sort(F.collect_list(F.struct("_r", "_n"))).alias("_l"))
    lists = lists.select("_q", "_p", F.transform("_l", lambda x: x["_n"]).alias("neg"))
    j = b.join(lists, (b["_q"] == lists["_q"]) & (b[pos] == lists["_p"]), "left").drop(lists["_q"]).drop("_p")
    j = j.withColumn("neg", F.coalesce("neg", F.array().cast("array<string>")))
    return j.withColumn("neg_num", F.size("neg").cast("bigint")).drop("_q")


def sample_corpus_keep_pos(corpus: DataFrame, qrels: DataFrame, queries: DataFrame, query_sample: int,
                           corpus_sample: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """First ``query_sample`` query ids (id order); keep all their positives; fill the corpus up to
    ``corpus_sample`` ids (grown to the positives when smaller) with hash-ordered other ids; drop
    queries with no kept positive. Returns (kept corpus, kept qrels)."""
    q = queries.select(F.col("_id").alias("query_id"))
    if query_sample > 0:
        q = q.orderBy("query_id").limit(query_sample)
    r = qrels.select(F.col("query-id").alias("query_id"), F.col("corpus-id").alias("corpus_id"))
    r = r.join(q, "query_id", "left_semi")
    c = corpus.select(F.col("_id").alias("corpus_id"), *[x for x in corpus.columns if x != "_id"])
    r = r.join(c.select("corpus_id"), "corpus_id", "left_semi")
    req = r.select("corpus_id").distinct()
    n_req = req.count()
    target = max(corpus_sample, n_req)
    need = target - n_req
    rest = c.select("corpus_id").join(req, "corpus_id", "left_anti")
    hk = h(seed, "corpus", F.col("corpus_id"))
    extra = select_first(rest, one_limit(rest, need), hk, ["corpus_id"])
    keep_ids = req.unionByName(extra.select("corpus_id"))
    kept = c.join(keep_ids, "corpus_id", "left_semi")
    return kept, r


def unique_texts(df: DataFrame, row_key: Sequence[str], arr: str = "neg") -> DataFrame:
    """Distinct texts of ``arr`` in first-appearance order (row key, position) with a dense ``text_id``."""
    ex = df.select(*row_key, F.posexplode(arr).alias("_p", "text")).filter(F.col("text").isNotNull())
    first = ex.groupBy("text").agg(F.min(F.struct(*[F.col(k) for k in row_key], F.col("_p"))).alias("_f"))
    first = first.select("text", *[F.col(f"_f.{k}").alias(f"_k{i}") for i, k in enumerate(row_key)], F.col("_f._p").alias("_kp"))
    order = [(f"_k{i}", True) for i in range(len(row_key))] + [("_kp", True)]
    return range_row_index(first, order, out="text_id").select("text", "text_id")


def neg_ids(df: DataFrame, ids: DataFrame, row_key: Sequence[str], arr: str = "neg", out: str = "neg_text_ids") -> DataFrame:
    """Map each text of ``arr`` to its id, keeping array order (NULL texts are skipped)."""
    ex = df.select(*row_key, F.posexplode(arr).alias("_p", "text")).filter(F.col("text").isNotNull())
    ex = ex.join(ids, "text")
    g = ex.groupBy(*row_key).agg(F.array_sort(F.collect_list(F.struct("_p", "text_id"))).alias("_s"))
    g = g.select(*row_key, F.transform("_s", lambda s: s["text_id"]).alias(out))
    j = df.join(g, list(row_key), "left")
    return j.withColumn(out, F.coalesce(out, F.array().cast("array<bigint>")))
