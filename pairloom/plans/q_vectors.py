"""Registered vector queries (P19, P20, J6, J8, E3, E4, G15, G16) and SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import joins as J
from ..operators import vectors as VO
from .fixtures import LOSS_IN_SQL, TRIP_SQL, Tables, loss_inputs, next_of_label
from .q_flat import FLAT_SQL, flat_pairs
from .registry import register


def _emb(t: Tables):
    return t.embeddings.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


@register("l2_normalize", """SELECT vec_id,
  list_transform(CAST(embedding AS DOUBLE[]), lambda x: round(x / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y))), 6)) AS v
FROM embeddings""")
def q_l2_normalize(t: Tables):
    e = _emb(t)
    return e.select("vec_id", F.transform(V.l2_normalize(F.col("v")), lambda x: F.round(x, 6)).alias("v"))


@register("truncate_dim", "SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[])[1:32], lambda x: round(x, 6)) AS v FROM embeddings")
def q_truncate_dim(t: Tables):
    return _emb(t).select("vec_id", F.transform(V.truncate_dim(F.col("v"), 32), lambda x: F.round(x, 6)).alias("v"))


@register("lookup_vectors", f"""WITH {LOSS_IN_SQL},
emb AS (SELECT vec_id AS emb_idx, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)
SELECT li.vec_id AS id, round(list_sum(a.embedding), 6) AS anc_sum, round(list_sum(p.embedding), 6) AS pos_sum,
       CASE WHEN n.embedding IS NULL THEN CAST([] AS DOUBLE[]) ELSE [round(list_sum(n.embedding), 6)] END AS neg_sums
FROM li JOIN emb a ON a.emb_idx = li.vec_id JOIN emb p ON p.emb_idx = li.pos_id LEFT JOIN emb n ON n.emb_idx = li.vec_id + 16""")
def q_lookup_vectors(t: Tables):
    li = loss_inputs(t)
    rows = li.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("anc_emb_idx"), F.col("pos_id").alias("pos_emb_idx"),
                     F.when(F.col("neg_teacher").isNotNull(), F.array(F.col("vec_id") + 16))
                     .otherwise(F.array().cast("array<bigint>")).alias("neg_emb_idx"))
    emb = _emb(t).select(F.col("vec_id").alias("emb_idx"), F.col("v").alias("embedding"))
    out = VO.lookup_vectors(rows, emb, key=("id",))
    s = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 6)
    return out.select("id", s(F.col("anc_emb_idx_vec")).alias("anc_sum"), s(F.col("pos_emb_idx_vec")).alias("pos_sum"),
                      F.transform("neg_vecs", lambda v: s(v)).alias("neg_sums"))


MINE_SQL = f"""WITH {LOSS_IN_SQL},
q AS (SELECT vec_id AS qid, CAST(vec_id // 2 AS VARCHAR) AS qtext, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
pos AS (SELECT DISTINCT q.qtext, x.cid FROM q JOIN (SELECT vec_id AS qid, vec_id AS cid FROM li UNION ALL SELECT vec_id, pos_id FROM li) x USING (qid)),
sc AS (SELECT q.qid, q.qtext, c.qid AS cid, list_dot_product(q.v, c.v) AS score FROM q JOIN q c ON TRUE),
f AS (SELECT sc.* FROM sc ANTI JOIN pos ON pos.qtext = sc.qtext AND pos.cid = sc.cid),
r AS (SELECT qid, cid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid) AS rank FROM f)
SELECT qid, rank, cid, round(score, 6) AS score FROM r WHERE rank <= 10"""


def _mine_inputs(t: Tables):
    li = t.memo("next_of_label", lambda: next_of_label(t))
    e = _emb(t)
    # two vector ids share a query text (vec_id div 2), so positives are unioned over both
    queries = e.select(F.col("vec_id").alias("qid"), F.floor(F.col("vec_id") / 2).cast("string").alias("qtext"), F.col("v").alias("vec"))
    corpus = e.select(F.col("vec_id").alias("cid"), F.col("v").alias("vec"))
    own = li.select(F.col("vec_id").alias("qid"), F.col("vec_id").alias("cid")).unionByName(
        li.select(F.col("vec_id").alias("qid"), F.col("pos_id").alias("cid")))
    return queries, corpus, own.join(queries.select("qid", "qtext"), "qid").select("qtext", "cid")


@register("mine_hard_negatives", MINE_SQL)
def q_mine_hard_negatives(t: Tables):
    return VO.mine_hard_negatives(*_mine_inputs(t), k=10)


def _named(c: str, mark: str):
    return F.concat(F.lit(mark), F.col(c).cast("string")).alias(c)


@register("mine_hard_negatives_text_ids", f"""WITH {LOSS_IN_SQL},
q AS (SELECT 'q' || vec_id AS qid, 'd' || vec_id AS did, CAST(vec_id // 2 AS VARCHAR) AS qtext, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
own AS (SELECT 'q' || vec_id AS qid, 'd' || vec_id AS cid FROM li UNION ALL SELECT 'q' || vec_id, 'd' || pos_id FROM li),
pos AS (SELECT DISTINCT q.qtext, own.cid FROM q JOIN own USING (qid)),
sc AS (SELECT q.qid, q.qtext, c.did AS cid, list_dot_product(q.v, c.v) AS score FROM q JOIN q c ON TRUE),
f AS (SELECT sc.* FROM sc ANTI JOIN pos ON pos.qtext = sc.qtext AND pos.cid = sc.cid),
r AS (SELECT qid, cid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid) AS rank FROM f)
SELECT qid, rank, cid, round(score, 6) AS score FROM r WHERE rank <= 10""")
def q_mine_hard_negatives_text_ids(t: Tables):
    """Ids are text, and the blocks are small, so that several meet at every scale."""
    queries, corpus, positives = _mine_inputs(t)
    return VO.mine_hard_negatives(queries.select(_named("qid", "q"), "qtext", "vec"), corpus.select(_named("cid", "d"), "vec"),
                                  positives.select("qtext", _named("cid", "d")), k=10, query_block=2048, corpus_block=400)


@register("two_nn_dimension", """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT a.vec_id AS q, b.vec_id AS c, list_distance(a.v, b.v) AS dist FROM v a JOIN v b ON a.vec_id <> b.vec_id),
r AS (SELECT q, dist, row_number() OVER (PARTITION BY q ORDER BY dist, c) AS k FROM d),
m AS (SELECT q, max(dist) FILTER (WHERE k = 1) AS r1, max(dist) FILTER (WHERE k = 2) AS r2 FROM r WHERE k <= 2 GROUP BY q),
mu AS (SELECT q, r2 / r1 AS mu FROM m WHERE r1 > 0),
n AS (SELECT count(*) AS n FROM mu),
o AS (SELECT mu, row_number() OVER (ORDER BY mu, q) - 1 AS i FROM mu)
SELECT count(*) AS n, round(sum(ln(mu) * -ln(1 - (i + 1) / n.n)) / sum(ln(mu) * ln(mu)), 6) AS dimension
FROM o, n WHERE i < floor(n.n * 0.9) GROUP BY n.n""")
def q_two_nn(t: Tables):
    e = _emb(t)
    return VO.two_nn_dimension(e.select(F.col("vec_id").alias("vid"), F.col("v").alias("vec")))


@register("iso_score", """WITH u AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
c AS (SELECT a.i, b.i AS j, covar_pop(a.x, b.x) AS c, count(*) AS n FROM u a JOIN u b USING (vec_id) GROUP BY a.i, b.i),
s AS (SELECT max(n) AS n, count(*) FILTER (WHERE i = j) AS dim, sum(c) FILTER (WHERE i = j) AS t, sum(c * c) AS f FROM c)
SELECT n, dim, round((t * t / f - 1) / (dim - 1), 6) AS iso_score FROM s""")
def q_iso_score(t: Tables):
    return VO.iso_score(_emb(t).select(F.col("v").alias("vec")))


def encode_sql(texts: str, key: str, dim: int = 64, n: int = 3) -> str:
    """CTEs from ``texts``(key, text) to ``vecs``(key, embedding): the default encoder in SQL."""
    return f"""padded AS (SELECT {key}, ' ' || coalesce(text, '') || ' ' AS s FROM {texts}),
grams AS (SELECT {key}, substr(s, CAST(i AS BIGINT), {n}) AS g FROM (SELECT {key}, s, unnest(range(1, greatest(length(s) - {n}, 0) + 2)) AS i FROM padded)),
draws AS (SELECT {key}, ('0x' || substr(md5(g), 1, 8))::BIGINT AS d FROM grams),
cells AS (SELECT {key}, d % {dim} AS b, CAST(sum(CASE WHEN (d >> 16) & 1 = 1 THEN 1 ELSE -1 END) AS DOUBLE) AS v FROM draws GROUP BY ALL),
norms AS (SELECT {key}, sqrt(sum(v * v)) AS size FROM cells GROUP BY {key}),
places AS (SELECT {key}, size, unnest(range({dim})) AS b FROM norms),
vecs AS (SELECT p.{key}, list(CAST(CASE WHEN p.size > 0 THEN coalesce(c.v, 0) / p.size ELSE 0 END AS FLOAT) ORDER BY p.b) AS embedding
  FROM places p LEFT JOIN cells c ON c.{key} = p.{key} AND c.b = p.b GROUP BY p.{key})"""


def _rounded(v):
    return F.transform(v, lambda x: F.round(x.cast("double"), 6))


@register("encode_texts", f"""WITH {FLAT_SQL},
{encode_sql('enc', 'emb_idx')}
SELECT emb_idx, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 6)) AS embedding FROM vecs""")
def q_encode_texts(t: Tables):
    from ..operators import ordering as O
    flat = O.dense_index(flat_pairs(t))
    return VO.encode_texts(flat, "text", ("emb_idx",)).select("emb_idx", _rounded("embedding").alias("embedding"))


@register("encode_unique", f"""WITH {TRIP_SQL},
ex AS (SELECT subset, id, unnest(neg) AS text, unnest(range(0, len(neg))) AS p FROM trip),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY subset, id, p) AS r FROM ex WHERE text IS NOT NULL) WHERE r = 1),
ids AS (SELECT text, row_number() OVER (ORDER BY subset, id, p) - 1 AS text_id FROM f),
{encode_sql('ids', 'text_id')},
g AS (SELECT ex.subset, ex.id, list(ids.text_id ORDER BY ex.p) AS neg_emb_idx,
        list(list_transform(v.embedding, lambda x: round(CAST(x AS DOUBLE), 6)) ORDER BY ex.p) AS neg_vecs
      FROM ex JOIN ids USING (text) JOIN vecs v USING (text_id) GROUP BY ALL)
SELECT t.subset, t.id, coalesce(g.neg_emb_idx, CAST([] AS BIGINT[])) AS neg_emb_idx, coalesce(g.neg_vecs, CAST([] AS DOUBLE[][])) AS neg_vecs
FROM trip t LEFT JOIN g USING (subset, id)""")
def q_encode_unique(t: Tables):
    """Encode each distinct negative text once, then map the vectors back in array order."""
    from .fixtures import triplets
    tr = triplets(t)
    ids = J.unique_texts(tr, ["subset", "id"])
    vecs = VO.encode_texts(ids.withColumnRenamed("text_id", "emb_idx"), "text", ("emb_idx",), length_col=None)
    withids = J.neg_ids(tr, ids, ["subset", "id"], out="neg_emb_idx")
    out = VO.lookup_vectors(withids.select("subset", "id", "neg_emb_idx"), vecs, idx_cols=(), key=("subset", "id"))
    return out.select("subset", "id", "neg_emb_idx", F.transform("neg_vecs", _rounded).alias("neg_vecs"))
