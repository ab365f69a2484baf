"""Registered batch-planning queries (W9–W14, P23) and SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import batches as B
from ..operators import ordering as O
from ..operators import pairs as P
from . import sqltext as S
from .q_flat import FLAT3_SQL, flat_triplets
from .registry import register

SEED, EPOCH, PER_RANK, WORLD = 42, 0, 8, 2
G = PER_RANK * WORLD
LABEL_TASKS = ["src1", "src2"]
H = S.H
_LT = ", ".join(f"'{x}'" for x in LABEL_TASKS)
ENC3_ROWS_SQL = f"""{FLAT3_SQL},
e3 AS (SELECT subset, id, max(label) FILTER (WHERE "column" = 'anc') AS label,
              coalesce(list(text ORDER BY slot) FILTER (WHERE "column" = 'neg'), CAST([] AS VARCHAR[])) AS neg,
              coalesce(list(emb_idx ORDER BY slot) FILTER (WHERE "column" = 'neg'), CAST([] AS BIGINT[])) AS neg_emb_idx
       FROM enc3 GROUP BY subset, id)"""


def plan_sql(single_task: bool = False) -> str:
    task = "'all'" if single_task else f"CASE WHEN subset IN ({_LT}) THEN subset || '|' || coalesce(label, '') ELSE subset END"
    s = SEED + EPOCH
    return f"""{ENC3_ROWS_SQL},
tk AS (SELECT *, {task} AS task FROM e3),
rn AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY {H(s, "'row'", 'subset', 'id')}, subset, id) - 1 AS rn FROM tk),
b0 AS (SELECT *, CAST(floor(rn / {G}) AS BIGINT) AS batch_no, CAST(rn % {G} AS INT) AS row_in_batch FROM rn),
full_b AS (SELECT task, batch_no FROM b0 GROUP BY ALL HAVING count(*) = {G}),
bt AS (SELECT task, batch_no, row_number() OVER (ORDER BY {H(s, "'batch'", 'task', 'batch_no')}, task, batch_no) - 1 AS batch_id FROM full_b),
plan AS (SELECT b0.*, bt.batch_id FROM b0 JOIN bt USING (task, batch_no))"""


def _encoded(t):
    return t.memo("encoded_triplets", lambda: P.regroup_triplets(O.dense_index(flat_triplets(t))).select(
        "subset", "id", "label", "neg", "neg_emb_idx"))


def _plan(t, single_task: bool = False):
    return B.batch_plan(_encoded(t), ["subset", "id"], PER_RANK, WORLD, SEED, EPOCH, LABEL_TASKS, single_task=single_task)


@register("batch_plan", f"WITH {plan_sql()} SELECT subset, id, task, batch_no, row_in_batch, batch_id FROM plan")
def q_batch_plan(t):
    return _plan(t).select("subset", "id", "task", "batch_no", "row_in_batch", "batch_id")


@register("batch_plan_anchor", f"WITH {plan_sql(True)} SELECT subset, id, batch_no, row_in_batch, batch_id FROM plan")
def q_batch_plan_anchor(t):
    return _plan(t, True).select("subset", "id", "batch_no", "row_in_batch", "batch_id")


@register("align_negatives", f"""WITH {plan_sql()},
m AS (SELECT *, least(len(neg), len(neg_emb_idx), 3) AS m FROM plan),
k AS (SELECT *, CAST(min(m) OVER (PARTITION BY batch_id) AS INT) AS k FROM m)
SELECT subset, id, batch_id, k, CASE WHEN k > 0 THEN neg[1:k] ELSE CAST([] AS VARCHAR[]) END AS neg,
       CASE WHEN k > 0 THEN neg_emb_idx[1:k] ELSE CAST([] AS BIGINT[]) END AS neg_emb_idx FROM k""")
def q_align_negatives(t):
    a = B.align_negatives(_plan(t), max_neg=3)
    return a.select("subset", "id", "batch_id", "k", "neg", "neg_emb_idx")


@register("rank_slice", f"""WITH {plan_sql()},
r AS (SELECT *, greatest(1, floor(count(*) OVER (PARTITION BY batch_id) / 3)) AS per FROM plan)
SELECT subset, id, batch_id, CAST(floor(row_in_batch / per) AS INT) AS rank,
       CAST(row_in_batch - floor(row_in_batch / per) * per AS INT) AS row_in_rank
FROM r WHERE floor(row_in_batch / per) < 3""")
def q_rank_slice(t):
    # 16-row batches over 3 ranks: 5 rows each, one row unused
    return B.rank_slice(_plan(t), 3).select("subset", "id", "batch_id", "rank", "row_in_rank")


@register("micro_chunks", f"""WITH {plan_sql()},
c AS (SELECT *, count(*) OVER (PARTITION BY batch_id) AS L FROM plan),
d AS (SELECT *, floor(L / 3) AS q, L % 3 AS r FROM c)
SELECT subset, id, batch_id, CAST(CASE WHEN row_in_batch < r * (q + 1) THEN floor(row_in_batch / (q + 1))
                                   ELSE r + floor((row_in_batch - r * (q + 1)) / greatest(q, 1)) END AS INT) AS chunk FROM d""")
def q_micro_chunks(t):
    return B.micro_chunks(_plan(t), 3, ["batch_id"], "row_in_batch").select("subset", "id", "batch_id", "chunk")


P_MAX = 12


def dyn_sql() -> str:
    s = SEED + EPOCH
    task = f"CASE WHEN subset IN ({_LT}) THEN subset || '|' || coalesce(label, '') ELSE subset END"
    gs = f"(CASE WHEN c > 1 THEN greatest(1, least({PER_RANK}, {P_MAX} // c)) ELSE {PER_RANK} END) * {WORLD}"
    kmin = f"(SELECT min(nl) FROM rn r WHERE r.task = s.task AND r.pos >= s.j AND r.pos < least(s.j + {G}, s.n))"
    return f"""WITH RECURSIVE {ENC3_ROWS_SQL},
tk AS (SELECT subset, id, len(neg) AS nl, {task} AS task FROM e3),
rn AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY {H(s, "'row'", 'subset', 'id')}, subset, id) - 1 AS pos,
              count(*) OVER (PARTITION BY task) AS n FROM tk),
steps(task, j, bno, n) AS (
  SELECT task, 0, 0, max(n) FROM rn GROUP BY task
  UNION ALL
  SELECT task, j + gs, bno + 1, n FROM (
    SELECT *, {gs} AS gs FROM (SELECT s.*, 1 + greatest(0, {kmin}) AS c FROM steps s WHERE s.j < s.n) x) y
  WHERE j + gs <= n),
bt0 AS (SELECT *, {gs} AS gs FROM (SELECT s.*, 1 + greatest(0, {kmin}) AS c FROM steps s WHERE s.j < s.n) x),
bt AS (SELECT * FROM bt0 WHERE j + gs <= n),
ids AS (SELECT task, bno, row_number() OVER (ORDER BY {H(s, "'batch'", 'task', 'bno')}, task, bno) - 1 AS batch_id FROM bt)
SELECT r.subset, r.id, r.task, CAST(b.bno AS BIGINT) AS batch_no, CAST(r.pos - b.j AS INT) AS row_in_batch, i.batch_id
FROM rn r JOIN bt b ON b.task = r.task AND r.pos >= b.j AND r.pos < b.j + b.gs JOIN ids i ON i.task = b.task AND i.bno = b.bno"""


@register("batch_plan_dynamic", dyn_sql())
def q_batch_plan_dynamic(t):
    enc = _encoded(t).withColumn("neg_len", F.size("neg"))
    out = B.batch_plan_dynamic(enc, ["subset", "id"], PER_RANK, WORLD, P_MAX, None, SEED, EPOCH, LABEL_TASKS,
                               block_rows=200)
    return out.select("subset", "id", "task", "batch_no", "row_in_batch", "batch_id")
