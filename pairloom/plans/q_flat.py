"""Registered flatten / regroup / stats / ordering queries (E1, E2, G1–G6, W1, W4, W6–W8) and oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordering as O
from ..operators import pairs as P
from ..operators import stats as ST
from . import sqltext as S
from .fixtures import INSTR_SQL, PAIR_SQL, TRIP_SQL, Tables, instructions, pairs, triplets
from .registry import register

SEED = 42
H = S.H
INSTRUCT_SQL = ("CASE WHEN length(coalesce(i.instruction, '')) > 0 THEN 'Instruct:' || i.instruction || chr(10) || 'Query:' || p.anc "
                "ELSE p.anc END")
FLAT_BODY = f"""flat AS (SELECT {INSTRUCT_SQL} AS text, p.subset, p.id, 'anc' AS "column", length({INSTRUCT_SQL}) AS len
         FROM pair p LEFT JOIN instr i USING (subset)
         UNION ALL SELECT pos, subset, id, 'pos', length(pos) FROM pair),
enc AS (SELECT *, row_number() OVER (ORDER BY len DESC, subset, id, "column") - 1 AS emb_idx FROM flat)"""
FLAT_SQL = f"{PAIR_SQL}, {INSTR_SQL},\n{FLAT_BODY}"

FLAT3_BODY = f"""t3 AS (SELECT p.*, {INSTRUCT_SQL} AS a FROM trip p LEFT JOIN instr i USING (subset)),
negs AS (SELECT subset, id, label, unnest(neg) AS text, unnest(range(0, len(neg))) AS slot FROM trip),
flat3 AS (SELECT a AS text, subset, id, 'anc' AS "column", -1 AS slot, label, length(a) AS len FROM t3
          UNION ALL SELECT pos, subset, id, 'pos', -1, label, length(pos) FROM t3
          UNION ALL SELECT text, subset, id, 'neg', slot, label, length(text) FROM negs WHERE text IS NOT NULL),
enc3 AS (SELECT *, row_number() OVER (ORDER BY len DESC, subset, id, "column", slot) - 1 AS emb_idx FROM flat3)"""
FLAT3_SQL = f"{TRIP_SQL}, {INSTR_SQL},\n{FLAT3_BODY}"
BOTH_FLAT_SQL = f"{TRIP_SQL}, {INSTR_SQL},\n{FLAT_BODY},\n{FLAT3_BODY}"


def flat_pairs(t: Tables):
    return P.flatten_pairs(pairs(t), instructions(t))


def flat_triplets(t: Tables):
    return P.flatten_triplets(triplets(t), instructions(t))


@register("flatten_pairs", f"WITH {FLAT_SQL} SELECT text, subset, id, \"column\", CAST(len AS BIGINT) AS len FROM flat")
def q_flatten_pairs(t: Tables):
    return flat_pairs(t)


@register("flatten_triplets", f"""WITH {FLAT3_SQL}
SELECT text, subset, id, "column", CAST(slot AS INT) AS slot, label, CAST(len AS BIGINT) AS len FROM flat3""")
def q_flatten_triplets(t: Tables):
    return flat_triplets(t)


@register("length_stats", f"""WITH {FLAT_SQL}
SELECT "column", count(*) AS count, min(len) AS min, max(len) AS max, round(avg(len), 6) AS mean,
       round(quantile_cont(len, 0.5), 6) AS median, round(stddev_pop(len), 6) AS std,
       round(quantile_cont(len, 0.25), 6) AS p25, round(quantile_cont(len, 0.75), 6) AS p75
FROM flat GROUP BY "column\"""")
def q_length_stats(t: Tables):
    return ST.length_stats(flat_pairs(t), "len", ["column"])


@register("dense_index", f"WITH {FLAT_SQL} SELECT subset, id, \"column\", CAST(len AS BIGINT) AS len, emb_idx FROM enc")
def q_dense_index(t: Tables):
    return O.dense_index(flat_pairs(t)).select("subset", "id", "column", "len", "emb_idx")


@register("regroup_pairs", f"""WITH {FLAT_SQL}
SELECT max(text) FILTER (WHERE "column" = 'anc') AS anc, max(text) FILTER (WHERE "column" = 'pos') AS pos,
       max(emb_idx) FILTER (WHERE "column" = 'anc') AS anc_emb_idx, max(emb_idx) FILTER (WHERE "column" = 'pos') AS pos_emb_idx,
       subset, id
FROM enc GROUP BY subset, id""")
def q_regroup_pairs(t: Tables):
    return P.regroup_pairs(O.dense_index(flat_pairs(t)))


@register("regroup_triplets", f"""WITH {FLAT3_SQL}
SELECT max(text) FILTER (WHERE "column" = 'anc') AS anc, max(text) FILTER (WHERE "column" = 'pos') AS pos,
       coalesce(list(text ORDER BY slot) FILTER (WHERE "column" = 'neg'), CAST([] AS VARCHAR[])) AS neg,
       coalesce(max(label) FILTER (WHERE "column" = 'anc'), max(label) FILTER (WHERE "column" = 'pos')) AS label,
       max(emb_idx) FILTER (WHERE "column" = 'anc') AS anc_emb_idx, max(emb_idx) FILTER (WHERE "column" = 'pos') AS pos_emb_idx,
       coalesce(list(emb_idx ORDER BY slot) FILTER (WHERE "column" = 'neg'), CAST([] AS BIGINT[])) AS neg_emb_idx,
       subset, id, count(*) FILTER (WHERE "column" = 'neg') AS neg_num
FROM enc3 GROUP BY subset, id""")
def q_regroup_triplets(t: Tables):
    return P.regroup_triplets(O.dense_index(flat_triplets(t)))


@register("dataset_summary", f"""WITH {PAIR_SQL},
r AS (SELECT subset, anc, row_number() OVER (PARTITION BY subset ORDER BY id) AS r FROM pair)
SELECT subset, (SELECT count(*) FROM pair q WHERE q.subset = r.subset) AS len, 'anc,pos,id' AS keys,
       list(anc ORDER BY r) AS sample
FROM r WHERE r <= 10 GROUP BY subset""")
def q_dataset_summary(t: Tables):
    return ST.dataset_summary(pairs(t).select("anc", "pos", "subset", "id"), "subset", "id", 10, "anc")


COMPACT_SQL = f"WITH {TRIP_SQL}, tc AS (SELECT subset, list_filter(neg, lambda x: x IS NOT NULL) AS neg FROM trip)"


def _compact(t: Tables):
    return triplets(t).select("subset", F.filter("neg", lambda x: x.isNotNull()).alias("neg"))


@register("neg_histogram", f"{COMPACT_SQL} SELECT subset, CAST(len(neg) AS BIGINT) AS n_neg, count(*) AS rows FROM tc GROUP BY 1, 2")
def q_neg_histogram(t: Tables):
    return ST.neg_histogram(_compact(t))


@register("neg_summary", f"""{COMPACT_SQL}
SELECT subset, CAST(min(len(neg)) AS BIGINT) AS min_neg, CAST(max(len(neg)) AS BIGINT) AS max_neg,
       round(avg(len(neg)), 6) AS mean_neg FROM tc GROUP BY subset""")
def q_neg_summary(t: Tables):
    return ST.neg_summary(_compact(t))


@register("drop_shortest", f"""WITH {FLAT_SQL}, n AS (SELECT count(*) AS n FROM enc)
SELECT subset, id, "column", emb_idx FROM enc, n WHERE emb_idx < n.n - floor(n.n * 0.01)""")
def q_drop_shortest(t: Tables):
    enc = O.dense_index(flat_pairs(t))
    n = enc.count()
    return O.drop_shortest(enc, n).select("subset", "id", "column", "emb_idx")


@register("shard_rows", f"""WITH {FLAT_SQL}, n AS (SELECT count(*) AS n FROM enc)
SELECT subset, id, "column", emb_idx, CAST(least(floor(emb_idx / (n.n // 3)), 2) AS INT) AS shard FROM enc, n""")
def q_shard_rows(t: Tables):
    enc = O.dense_index(flat_pairs(t))
    return O.shard_rows(enc, enc.count(), 3).select("subset", "id", "column", "emb_idx", "shard")


@register("sample_per_subset", f"""WITH {PAIR_SQL},
r AS (SELECT subset, id, anc, row_number() OVER (PARTITION BY subset ORDER BY {H(SEED, 'subset', 'id')}, subset, id) - 1 AS rk FROM pair)
SELECT subset, id, anc, rk FROM r WHERE rk < 20""")
def q_sample_per_subset(t: Tables):
    p = pairs(t).select("subset", "id", "anc")
    return O.sample_per_key(p, 20, SEED, ["subset", "id"], group=["subset"]).withColumnRenamed("_rk", "rk")


@register("train_test_split", f"""WITH {PAIR_SQL}, n AS (SELECT count(*) AS n FROM pair),
r AS (SELECT subset, id, row_number() OVER (ORDER BY {H(SEED, "'split'", 'subset', 'id')}, subset, id) - 1 AS rk FROM pair)
SELECT subset, id, CASE WHEN rk < greatest(1, floor(least(n.n * 0.1, 1000))) THEN 'test' ELSE 'train' END AS split FROM r, n""")
def q_train_test_split(t: Tables):
    return O.train_test_split(pairs(t).select("subset", "id"), SEED, ["subset", "id"])
