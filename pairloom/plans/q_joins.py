"""Registered join and mix queries (J1–J5, J7, G7–G10, P21, U2, W2) and SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import mix as MX
from ..operators import ordering as O
from ..operators import pairs as P
from . import sqltext as S
from .fixtures import BEIR_SQL, CONV_SQL, TRIP_SQL, Tables, beir, conv_qa, triplets
from .q_flat import BOTH_FLAT_SQL, FLAT3_SQL, flat_pairs, flat_triplets
from .registry import register

SEED = 42
H = S.H


@register("qrels_pairs", f"""WITH {BEIR_SQL}
SELECT r."query-id" AS query_id, r."corpus-id" AS corpus_id, q.text AS anc, c.title || ' ' || c.text AS pos
FROM qrels r JOIN queries q ON q._id = r."query-id" JOIN corpus c ON c._id = r."corpus-id\"""")
def q_qrels_pairs(t: Tables):
    queries, corpus, qrels = beir(t)
    return J.qrels_pairs(qrels, queries, corpus)


@register("positives_by_query", f"""WITH {BEIR_SQL}
SELECT "query-id" AS query_id, list_sort(list(DISTINCT "corpus-id")) AS pos_ids FROM qrels GROUP BY 1""")
def q_positives_by_query(t: Tables):
    queries, _, qrels = beir(t)
    return J.positives_by_query(qrels, queries)[0]


@register("positives_by_query_text", f"""WITH {BEIR_SQL}
SELECT q.text AS query, list_sort(list(DISTINCT r."corpus-id")) AS pos_ids
FROM qrels r JOIN queries q ON q._id = r."query-id" GROUP BY q.text""")
def q_positives_by_text(t: Tables):
    queries, _, qrels = beir(t)
    return J.positives_by_query(qrels, queries)[1]


@register("sample_corpus_keep_pos", f"""WITH {BEIR_SQL},
tq AS (SELECT _id FROM queries ORDER BY _id LIMIT 50),
r AS (SELECT q."query-id", q."corpus-id" FROM qrels q WHERE q."query-id" IN (SELECT _id FROM tq)
        AND q."corpus-id" IN (SELECT _id FROM corpus)),
req AS (SELECT DISTINCT "corpus-id" AS cid FROM r),
need AS (SELECT greatest(300, (SELECT count(*) FROM req)) - (SELECT count(*) FROM req) AS k),
rest AS (SELECT _id AS cid, row_number() OVER (ORDER BY {H(SEED, "'corpus'", '_id')}, _id) - 1 AS rk
         FROM corpus WHERE _id NOT IN (SELECT cid FROM req))
SELECT c._id AS corpus_id, c.title FROM corpus c
WHERE c._id IN (SELECT cid FROM req) OR c._id IN (SELECT cid FROM rest, need WHERE rk < need.k)""")
def q_sample_corpus(t: Tables):
    queries, corpus, qrels = beir(t)
    kept, _ = J.sample_corpus_keep_pos(corpus, qrels, queries, query_sample=50, corpus_sample=300, seed=SEED)
    return kept.select("corpus_id", "title")


@register("attach_negatives", f"""WITH {FLAT3_SQL},
enc AS (SELECT max(text) FILTER (WHERE "column" = 'anc') AS anc, max(text) FILTER (WHERE "column" = 'pos') AS pos,
               max(emb_idx) FILTER (WHERE "column" = 'anc') AS anc_emb_idx, max(emb_idx) FILTER (WHERE "column" = 'pos') AS pos_emb_idx,
               coalesce(list(text ORDER BY slot) FILTER (WHERE "column" = 'neg'), CAST([] AS VARCHAR[])) AS neg,
               coalesce(list(emb_idx ORDER BY slot) FILTER (WHERE "column" = 'neg'), CAST([] AS BIGINT[])) AS neg_emb_idx,
               max(label) FILTER (WHERE "column" = 'anc') AS label, subset, id FROM enc3 GROUP BY subset, id)
SELECT b.anc, b.pos, b.anc_emb_idx, b.pos_emb_idx, b.subset, b.id,
       coalesce(n.neg, CAST([] AS VARCHAR[])) AS neg, coalesce(n.neg_emb_idx, CAST([] AS BIGINT[])) AS neg_emb_idx
FROM enc b LEFT JOIN (SELECT * FROM enc WHERE label = 'en') n
  ON n.anc = b.anc AND n.pos = b.pos AND n.anc_emb_idx = b.anc_emb_idx AND n.pos_emb_idx = b.pos_emb_idx AND n.subset = b.subset""")
def q_attach_negatives(t: Tables):
    enc = t.memo("attach_encoded", lambda: P.regroup_triplets(O.dense_index(flat_triplets(t))))  # read by both checks and both sides
    base = enc.select("anc", "pos", "anc_emb_idx", "pos_emb_idx", "subset", "id")
    negs = enc.filter(F.col("label") == "en")
    return J.attach_negatives(base, negs)


@register("raw_negatives_by_pair", f"""WITH {CONV_SQL},
base AS (SELECT 'conv' AS subset, query AS anc, p AS pos FROM (SELECT query, unnest(answers) AS p FROM conv)),
raw AS (SELECT 'conv' AS subset, c.query AS anc, c.answers[1] AS pos, unnest(n.answers) AS neg
        FROM conv c JOIN conv n ON n.conv_id = c.conv_id + 1 WHERE len(c.answers) > 0),
rn AS (SELECT subset, anc, pos, list_sort(list(DISTINCT neg)) AS negs FROM raw WHERE neg IS NOT NULL GROUP BY ALL)
SELECT b.subset, b.anc, b.pos, coalesce(rn.negs, CAST([] AS VARCHAR[])) AS neg
FROM base b LEFT JOIN rn USING (subset, anc, pos)""")
def q_raw_negatives_by_pair(t: Tables):
    qa = conv_qa(t)
    base = qa.select(F.lit("conv").alias("subset"), F.col("query").alias("anc"), F.explode("answers").alias("pos"))
    nxt = qa.select((F.col("conv_id") - 1).alias("conv_id"), F.col("answers").alias("_n"))
    raw = qa.filter(F.size("answers") > 0).join(nxt, "conv_id").select(
        F.lit("conv").alias("subset"), F.col("query").alias("anc"), F.element_at("answers", 1).alias("pos"),
        F.explode("_n").alias("neg"))
    return J.raw_negatives_by_pair(base, raw)


_SHAPE_SQL = "CASE conv_id % 3 WHEN 0 THEN 'query_pos_neg' WHEN 1 THEN 'list' ELSE 'query_pos' END"


@register("raw_negatives_by_shape", f"""WITH {CONV_SQL},
s AS (SELECT *, {_SHAPE_SQL} AS shape FROM conv),
base AS (SELECT shape AS subset, query AS anc, p AS pos FROM (SELECT shape, query, unnest(answers) AS p FROM s)),
raw AS (SELECT DISTINCT s.shape AS subset, s.query AS anc, s.answers[1] AS pos, n.answers AS neg
        FROM s JOIN conv n ON n.conv_id = s.conv_id + 1 WHERE len(s.answers) > 0 AND s.shape <> 'query_pos')
SELECT b.subset, b.anc, b.pos, coalesce(raw.neg, CAST([] AS VARCHAR[])) AS neg
FROM base b LEFT JOIN raw ON raw.subset = b.subset AND raw.anc IS NOT DISTINCT FROM b.anc AND raw.pos IS NOT DISTINCT FROM b.pos""")
def q_raw_negatives_by_shape(t: Tables):
    """Each conversation stands in a file of one of three shapes; its negatives are the answers of the next one."""
    qa = conv_qa(t).withColumn("shape", F.when(F.col("conv_id") % 3 == 0, "query_pos_neg").when(F.col("conv_id") % 3 == 1, "list").otherwise("query_pos"))
    base = qa.select(F.col("shape").alias("subset"), F.col("query").alias("anc"), F.explode("answers").alias("pos"))
    nxt = qa.select((F.col("conv_id") - 1).alias("conv_id"), F.col("answers").alias("neg"))
    raw = qa.filter(F.size("answers") > 0).join(nxt, "conv_id").select(
        "shape", F.col("shape").alias("subset"), F.col("query").alias("anc"), F.element_at("answers", 1).alias("pos"), "neg")
    return J.raw_negatives_by_shape(base, raw)


_BQ = "'Instruct:Find the reply' || chr(10) || 'Query:' || query"


@register("raw_negatives_by_query", f"""WITH {CONV_SQL},
base AS (SELECT conv_id, {_BQ} AS anc, answers[1] AS pos, {S.strip('query')} AS q FROM conv WHERE len(answers) > 0),
origin AS (SELECT {S.strip('c.query')} AS q, unnest(n.answers) AS n FROM conv c JOIN conv n ON n.conv_id IN (c.conv_id + 1, c.conv_id + 2)),
o AS (SELECT DISTINCT q, n FROM origin WHERE length(n) > 0 AND n <> q AND q IN (SELECT q FROM base)),
oh AS (SELECT q, n, {H(SEED, 'q', 'n')} AS h FROM o),
ot AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY h, n) AS r0 FROM oh) WHERE r0 <= 8),
pairs AS (SELECT DISTINCT q, pos FROM base),
cand AS (SELECT p.q, p.pos, ot.n, ot.h FROM pairs p JOIN ot USING (q) WHERE ot.n <> p.pos),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, pos ORDER BY h, n) AS r FROM cand) WHERE r <= 7),
l AS (SELECT q, pos, list(n ORDER BY r) AS neg FROM top GROUP BY q, pos)
SELECT b.conv_id, b.anc, b.pos, coalesce(l.neg, CAST([] AS VARCHAR[])) AS neg, CAST(len(coalesce(l.neg, [])) AS BIGINT) AS neg_num
FROM base b LEFT JOIN l ON l.q = b.q AND l.pos = b.pos""")
def q_raw_negatives_by_query(t: Tables):
    qa = conv_qa(t)
    base = qa.filter(F.size("answers") > 0).select(
        "conv_id", F.concat(F.lit("Instruct:Find the reply\nQuery:"), F.col("query")).alias("anc"),
        F.element_at("answers", 1).alias("pos"))
    n1 = qa.select((F.col("conv_id") - 1).alias("conv_id"), F.col("answers").alias("_n"))
    n2 = qa.select((F.col("conv_id") - 2).alias("conv_id"), F.col("answers").alias("_n"))
    origin = qa.join(n1.unionByName(n2), "conv_id").select("query", F.col("_n").alias("neg"))
    return J.raw_negatives_by_query(base, origin, seed=SEED, cap=7)


@register("unique_texts", f"""WITH {TRIP_SQL},
ex AS (SELECT subset, id, unnest(neg) AS text, unnest(range(0, len(neg))) AS p FROM trip),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY subset, id, p) AS r FROM ex WHERE text IS NOT NULL) WHERE r = 1)
SELECT text, row_number() OVER (ORDER BY subset, id, p) - 1 AS text_id FROM f""")
def q_unique_texts(t: Tables):
    return J.unique_texts(triplets(t), ["subset", "id"])


@register("neg_ids", f"""WITH {TRIP_SQL},
ex AS (SELECT subset, id, unnest(neg) AS text, unnest(range(0, len(neg))) AS p FROM trip),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY subset, id, p) AS r FROM ex WHERE text IS NOT NULL) WHERE r = 1),
ids AS (SELECT text, row_number() OVER (ORDER BY subset, id, p) - 1 AS text_id FROM f),
g AS (SELECT ex.subset, ex.id, list(ids.text_id ORDER BY ex.p) AS neg_text_ids FROM ex JOIN ids USING (text) GROUP BY ALL)
SELECT t.subset, t.id, coalesce(g.neg_text_ids, CAST([] AS BIGINT[])) AS neg_text_ids FROM trip t LEFT JOIN g USING (subset, id)""")
def q_neg_ids(t: Tables):
    tr = triplets(t)
    ids = J.unique_texts(tr, ["subset", "id"])
    return J.neg_ids(tr, ids, ["subset", "id"]).select("subset", "id", "neg_text_ids")


EXCL = ["src3", "src7"]
_EXCL_SQL = ", ".join(f"'{x}'" for x in EXCL)
PLAN_SQL = f"""{TRIP_SQL},
sizes AS (SELECT subset, count(*) AS rows FROM trip WHERE subset NOT IN ({_EXCL_SQL}) GROUP BY subset),
s2 AS (SELECT subset, least(rows, 40) AS len FROM sizes WHERE least(rows, 40) > 0),
plan AS (SELECT subset, len, CAST(least(len, floor(len * (CAST(300 AS DOUBLE) / (SELECT sum(len) FROM s2)))) AS BIGINT) AS alloc FROM s2)"""
MIX_SQL = f"""{PLAN_SQL},
rk AS (SELECT t.*, row_number() OVER (PARTITION BY subset ORDER BY {H(SEED, 'subset', 'id')}, subset, id) - 1 AS rk FROM trip t),
mix AS (SELECT coalesce(nullif(anc, ''), '') AS anc, coalesce(nullif(pos, ''), '') AS pos, coalesce(neg, CAST([] AS VARCHAR[])) AS neg,
               coalesce(label, '') AS label, subset FROM rk JOIN plan USING (subset) WHERE rk < plan.alloc)"""


def _plan(t: Tables):
    return MX.allocation_plan(triplets(t), 300, cap=40, excluded=EXCL)


def _mix(t: Tables):
    return MX.build_mix(triplets(t), _plan(t), SEED, ["subset", "id"])


@register("allocation_plan", f"WITH {PLAN_SQL} SELECT subset, len, alloc FROM plan")
def q_allocation_plan(t: Tables):
    return _plan(t)


@register("exclude_subsets", f"WITH {TRIP_SQL} SELECT subset, id FROM trip WHERE subset NOT IN ({_EXCL_SQL})")
def q_exclude_subsets(t: Tables):
    ex = t.spark.createDataFrame([(x,) for x in EXCL], "subset string")
    return MX.exclude_subsets(triplets(t), ex).select("subset", "id")


@register("build_mix", f"WITH {MIX_SQL} SELECT * FROM mix")
def q_build_mix(t: Tables):
    return _mix(t)


@register("mix_summary", f"""WITH {MIX_SQL}
SELECT CASE WHEN len(neg) > 0 THEN 'triplet' ELSE 'pair' END AS kind, subset, count(*) AS rows FROM mix GROUP BY ROLLUP (1, 2)""")
def q_mix_summary(t: Tables):
    from ..operators import stats as ST
    return ST.mix_summary(MX.mix_kind(_mix(t)))


FULL_SQL = f"""{TRIP_SQL}, {CONV_SQL},
pool AS (SELECT nullif(subset, 'src4') AS subset, CAST(id AS VARCHAR) AS id, anc, pos, neg, '' AS label, 'planned' AS role FROM trip WHERE subset <> 'src1'
  UNION ALL SELECT 'src1', CAST(conv_id AS VARCHAR), query, answers[1], CAST([] AS VARCHAR[]), 'reply', 'replacement' FROM conv),
sizes AS (SELECT subset, least(count(*), 40) AS len FROM pool WHERE coalesce(subset NOT IN ({_EXCL_SQL}), true) GROUP BY subset),
plan AS (SELECT subset, CAST(least(len, floor(len * (CAST(300 AS DOUBLE) / (SELECT sum(len) FROM sizes)))) AS BIGINT) AS alloc FROM sizes),
rk AS (SELECT *, row_number() OVER (PARTITION BY subset ORDER BY {H(SEED, 'subset', 'id')}, id) AS rk FROM pool),
full_mix AS (
  SELECT r.anc, r.pos, r.neg, r.label, r.subset, r.role FROM rk r JOIN plan p ON p.subset IS NOT DISTINCT FROM r.subset WHERE r.rk <= p.alloc
  UNION ALL SELECT query, coalesce(answers[1], ''), answers[2:len(answers)], '', 'replies' || CAST(conv_id % 2 AS VARCHAR), 'whole' FROM conv
  UNION ALL SELECT CAST(item_id AS VARCHAR), text, CAST([] AS VARCHAR[]), '', 'claims', 'whole' FROM benchmark),
full_rows AS (SELECT coalesce(anc, '') AS anc, coalesce(pos, '') AS pos, neg, label, subset, role FROM full_mix)"""


def _full_mix(t: Tables):
    """Planned triplets (one subset without a name), one subset replaced by labelled replies, two whole subsets and one more with other column names."""
    qa = conv_qa(t)
    planned = triplets(t).withColumn("subset", F.nullif(F.col("subset"), F.lit("src4")))
    replies = qa.select(F.col("conv_id").alias("id"), F.col("query").alias("anc"), F.try_element_at("answers", F.lit(1)).alias("pos"), F.lit("reply").alias("label"))
    whole = qa.select(F.concat(F.lit("replies"), F.col("conv_id") % 2).alias("subset"), F.col("query").alias("anc"), F.try_element_at("answers", F.lit(1)).alias("pos"),
                      F.expr("filter(answers, (x, i) -> i > 0)").alias("neg"), F.lit("unused").alias("label"))
    claims = t.benchmark.select(F.col("item_id").alias("query"), F.col("text").alias("document"))
    sources = [MX.MixSource(planned), MX.MixSource(replies, "replacement", "src1"), MX.MixSource(whole, "whole"), MX.MixSource(claims, "whole", "claims")]
    return MX.build_full_mix(sources, 300, SEED, ["id"], cap=40, excluded=EXCL)


@register("build_full_mix", f"WITH {FULL_SQL} SELECT * FROM full_rows")
def q_build_full_mix(t: Tables):
    return _full_mix(t)


@register("full_mix_counts", f"WITH {FULL_SQL} SELECT role, subset, count(*) AS rows FROM full_rows GROUP BY role, subset")
def q_full_mix_counts(t: Tables):
    return MX.full_mix_counts(_full_mix(t))


@register("concat_rebase", f"""WITH {BOTH_FLAT_SQL},
a AS (SELECT 'pairs' AS source, subset, id, max(emb_idx) FILTER (WHERE "column" = 'anc') AS anc_emb_idx,
             max(emb_idx) FILTER (WHERE "column" = 'pos') AS pos_emb_idx, CAST(NULL AS BIGINT[]) AS neg_emb_idx FROM enc GROUP BY subset, id),
nA AS (SELECT count(*) AS n FROM flat),
b AS (SELECT 'triplets' AS source, subset, id, max(emb_idx) FILTER (WHERE "column" = 'anc') + max(nA.n) AS anc_emb_idx,
             max(emb_idx) FILTER (WHERE "column" = 'pos') + max(nA.n) AS pos_emb_idx,
             coalesce(list(emb_idx + nA.n ORDER BY slot) FILTER (WHERE "column" = 'neg'), CAST([] AS BIGINT[])) AS neg_emb_idx
      FROM enc3, nA GROUP BY subset, id)
SELECT * FROM a UNION ALL SELECT * FROM b""")
def q_concat_rebase(t: Tables):
    fa = flat_pairs(t)
    n_first = fa.count()
    a = P.regroup_pairs(O.dense_index(fa)).select(F.lit("pairs").alias("source"), "subset", "id", "anc_emb_idx", "pos_emb_idx")
    b = P.regroup_triplets(O.dense_index(flat_triplets(t))).select(
        F.lit("triplets").alias("source"), "subset", "id", "anc_emb_idx", "pos_emb_idx", "neg_emb_idx")
    return MX.concat_rebase(a, b, n_first).select("source", "subset", "id", "anc_emb_idx", "pos_emb_idx", "neg_emb_idx")
