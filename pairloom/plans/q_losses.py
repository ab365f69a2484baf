"""Registered loss-metric queries (L1–L10) and SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import losses as L
from .fixtures import LOSS_IN_SQL, NEG_STEPS, Tables, loss_inputs, loss_inputs_multi
from .registry import register

DIM = 32
BV_SQL = f"""{LOSS_IN_SQL},
bv AS (SELECT batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY row_in_batch) - 1 AS i, student AS s, teacher[1:{DIM}] AS t,
              pos_student, pos_teacher[1:{DIM}] AS pt, neg_student, neg_teacher[1:{DIM}] AS nt,
              min(CASE WHEN neg_teacher IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY batch_id) AS k FROM li),
cand AS (SELECT batch_id, i * (1 + k) AS j, pos_student AS cs, pt AS ct FROM bv
         UNION ALL SELECT batch_id, i * (1 + k) + 1, neg_student, nt FROM bv WHERE k = 1)"""


#: The same CTEs with a list of negatives for each row; K is the least number of a batch.
BV_MULTI_SQL = f"""{LOSS_IN_SQL},
ng AS (SELECT li.vec_id, list(g.v ORDER BY g.vec_id) AS negs FROM li CROSS JOIN (SELECT unnest({list(NEG_STEPS)}) AS step) JOIN e g ON g.vec_id = li.vec_id + step GROUP BY li.vec_id),
bv AS (SELECT li.batch_id, row_number() OVER (PARTITION BY li.batch_id ORDER BY li.row_in_batch) - 1 AS i, li.student AS s, li.teacher[1:{DIM}] AS t,
              li.pos_student, li.pos_teacher[1:{DIM}] AS pt, ng.negs, min(coalesce(len(ng.negs), 0)) OVER (PARTITION BY li.batch_id) AS k
       FROM li LEFT JOIN ng ON ng.vec_id = li.vec_id),
cand AS (SELECT batch_id, i * (1 + k) AS j, pos_student AS cs, pt AS ct FROM bv
         UNION ALL SELECT batch_id, i * (1 + k) + r.c, negs[r.c][33:64], negs[r.c][1:{DIM}] FROM bv JOIN (SELECT unnest([1, 2, 3]) AS c) r ON r.c <= k)"""


def _bv_multi(t: Tables):
    return L.batch_vectors(loss_inputs_multi(t), DIM)


def _bv(t: Tables, use_pos: bool = True, use_neg: bool = True):
    return L.batch_vectors(loss_inputs(t), DIM, use_pos, use_neg)


def _lse(z: str, part: str = "batch_id, i") -> str:
    """SQL pieces: per-row log-sum-exp of column ``z`` in CTE ``zz``."""
    return f"""zm AS (SELECT *, max({z}) OVER (PARTITION BY {part}) AS m_ FROM zz),
lse AS (SELECT {part}, max(m_) + ln(sum(exp({z} - m_))) AS lse FROM zm GROUP BY {part})"""


def kld_sql(temp: float, taid: float | None = None, inputs: str = BV_SQL) -> str:
    zt = "zt0" if taid is None else f"({1 - taid!r} * zs + {taid!r} * zt0)"
    return f"""WITH {inputs},
z0 AS (SELECT a.batch_id, a.i, c.j, list_cosine_similarity(a.s, c.cs) / {temp!r} AS zs, list_cosine_similarity(a.t, c.ct) / {temp!r} AS zt0
       FROM bv a JOIN cand c USING (batch_id)),
z AS (SELECT batch_id, i, j, zs, {zt} AS zt FROM z0),
ms AS (SELECT *, max(zs) OVER w AS mxs, max(zt) OVER w AS mxt FROM z WINDOW w AS (PARTITION BY batch_id, i)),
l AS (SELECT batch_id, i, max(mxs) + ln(sum(exp(zs - mxs))) AS ls, max(mxt) + ln(sum(exp(zt - mxt))) AS lt FROM ms GROUP BY batch_id, i),
kl AS (SELECT z.batch_id, sum(exp(z.zt - l.lt) * ((z.zt - l.lt) - (z.zs - l.ls))) AS s, count(DISTINCT z.i) AS b
       FROM z JOIN l USING (batch_id, i) GROUP BY z.batch_id)
SELECT batch_id, round(s / b * greatest(1.0, {temp!r} * {temp!r}), 6) AS loss FROM kl"""


def ce_sql(key: str, temp: float = L.CSE_TEMP, inputs: str = BV_SQL) -> str:
    """Cross-entropy of cos(s, cand.<key>)/temp with target i·C (CKD: key=ct, InfoNCE: key=cs)."""
    return f"""{inputs},
zz AS (SELECT a.batch_id, a.i, a.k, c.j, list_cosine_similarity(a.s, c.{key}) / {temp!r} AS z FROM bv a JOIN cand c USING (batch_id)),
{_lse('z')},
ce AS (SELECT zz.batch_id, avg(lse.lse - zz.z) AS loss FROM zz JOIN lse USING (batch_id, i) WHERE zz.j = zz.i * (1 + zz.k) GROUP BY zz.batch_id)"""


@register("candidate_layout", f"""WITH {BV_SQL}
SELECT b.batch_id, CAST(r.row_in_batch AS INT) AS row_in_batch, CAST(c.j - b.i * (1 + b.k) AS INT) AS c,
       CAST(r.row_in_batch * (1 + b.k) + (c.j - b.i * (1 + b.k)) AS BIGINT) AS cand_index, (c.j = b.i * (1 + b.k)) AS is_target
FROM bv b JOIN cand c ON c.batch_id = b.batch_id AND c.j >= b.i * (1 + b.k) AND c.j < (b.i + 1) * (1 + b.k)
JOIN (SELECT batch_id, row_in_batch, row_number() OVER (PARTITION BY batch_id ORDER BY row_in_batch) - 1 AS i FROM li) r
  ON r.batch_id = b.batch_id AND r.i = b.i""")
def q_candidate_layout(t: Tables):
    return L.candidate_layout(_bv(t))


@register("candidate_layout_multi", f"""WITH {BV_MULTI_SQL}
SELECT r.batch_id, r.row_in_batch, CAST(c.c AS INT) AS c, CAST(r.row_in_batch * (1 + b.k) + c.c AS BIGINT) AS cand_index, c.c = 0 AS is_target
FROM (SELECT batch_id, row_in_batch, row_number() OVER (PARTITION BY batch_id ORDER BY row_in_batch) - 1 AS i FROM li) r
JOIN bv b ON b.batch_id = r.batch_id AND b.i = r.i JOIN (SELECT unnest([0, 1, 2, 3]) AS c) c ON c.c <= b.k""")
def q_candidate_layout_multi(t: Tables):
    return L.candidate_layout(_bv_multi(t))


MSE_SQL = f"""WITH {BV_SQL}
SELECT batch_id, round(sum(list_sum(list_transform(range(1, {DIM} + 1), lambda d: (s[d] - t[d]) * (s[d] - t[d])))) / (count(*) * {DIM}) {{scale}}, 6) AS loss
FROM bv GROUP BY batch_id"""


@register("loss_mse", MSE_SQL.replace("{scale}", ""))
def q_loss_mse(t: Tables):
    return L.loss_mse(_bv(t))


@register("loss_kld", kld_sql(1.0))
def q_loss_kld(t: Tables):
    return L.loss_kld(_bv(t), temp=1.0)


@register("loss_ckd", f"WITH {ce_sql('ct')} SELECT batch_id, round(loss, 6) AS loss FROM ce")
def q_loss_ckd(t: Tables):
    return L.loss_ckd(_bv(t))


@register("loss_infonce", f"WITH {ce_sql('cs')} SELECT batch_id, round(loss, 6) AS loss FROM ce")
def q_loss_infonce(t: Tables):
    return L.loss_infonce(_bv(t))


@register("loss_kld_multi", kld_sql(1.0, inputs=BV_MULTI_SQL))
def q_loss_kld_multi(t: Tables):
    return L.loss_kld(_bv_multi(t), temp=1.0)


@register("loss_ckd_multi", f"WITH {ce_sql('ct', inputs=BV_MULTI_SQL)} SELECT batch_id, round(loss, 6) AS loss FROM ce")
def q_loss_ckd_multi(t: Tables):
    return L.loss_ckd(_bv_multi(t))


@register("loss_infonce_multi", f"WITH {ce_sql('cs', inputs=BV_MULTI_SQL)} SELECT batch_id, round(loss, 6) AS loss FROM ce")
def q_loss_infonce_multi(t: Tables):
    return L.loss_infonce(_bv_multi(t))


@register("loss_combined", f"""WITH {ce_sql('cs')},
kld AS ({kld_sql(1.0).replace('WITH ' + BV_SQL + ',', 'WITH ' + BV_SQL.replace('e AS (', 'e2 AS (').replace('FROM e ', 'FROM e2 ').replace('JOIN e ', 'JOIN e2 ') + ',', 1)})
SELECT batch_id, round(0.5 * kld.loss + 0.5 * round(ce.loss, 6), 6) AS loss, kld.loss AS distill_loss, round(ce.loss, 6) AS cse_loss
FROM kld JOIN ce USING (batch_id)""")
def q_loss_combined(t: Tables):
    bv = _bv(t)
    return L.loss_combined(L.loss_kld(bv, temp=1.0), bv, 0.5)


@register("loss_taid", MSE_SQL.replace("{scale}", f"* {0.4 * 0.4!r}"))
def q_loss_taid(t: Tables):
    return L.loss_mse(_bv(t), taid_t=0.4)


@register("loss_taid_kld", kld_sql(1.0, taid=0.4))
def q_loss_taid_kld(t: Tables):
    return L.loss_kld(_bv(t), temp=1.0, taid_t=0.4)


JS_SQL = f"""WITH {BV_SQL},
p AS (SELECT batch_id, i, s, pt FROM bv),
cosl AS (SELECT batch_id, avg(1 - list_cosine_similarity(s, pt)) AS c FROM p GROUP BY batch_id),
sims AS (SELECT a.batch_id, a.i, b.i AS k, list_cosine_similarity(a.s, b.s) AS ss, list_cosine_similarity(a.pt, b.pt) AS tt
         FROM p a JOIN p b USING (batch_id)),
siml AS (SELECT batch_id, avg((ss - tt) * (ss - tt)) AS m FROM sims GROUP BY batch_id),
up AS (SELECT * FROM sims WHERE i < k),
pr AS (SELECT x.batch_id, y.ss - x.ss AS ds, y.tt - x.tt AS dt FROM up x JOIN up y ON x.batch_id = y.batch_id
       AND (x.i < y.i OR (x.i = y.i AND x.k < y.k))),
tri AS (SELECT batch_id, avg(greatest(ds * CASE WHEN dt < 0 THEN 1 ELSE -1 END + 0.015, 0)) AS h FROM pr GROUP BY batch_id)
SELECT batch_id, round(10 * c + 200 * m + 20 * coalesce(h, 0), 6) AS loss, round(10 * c, 6) AS cosine_loss,
       round(200 * m, 6) AS similarity_loss, round(20 * coalesce(h, 0), 6) AS triplet_loss
FROM cosl JOIN siml USING (batch_id) LEFT JOIN tri USING (batch_id)"""


@register("loss_js", JS_SQL)
def q_loss_js(t: Tables):
    return L.loss_js(_bv(t, use_pos=True, use_neg=False))


QUEUE_SQL = f"""WITH {BV_SQL},
a AS (SELECT batch_id, i, s, t FROM bv),
nb AS (SELECT batch_id, count(*) AS n FROM a GROUP BY batch_id),
pairs AS (SELECT b.batch_id AS b, b2.batch_id AS b2,
                 coalesce((SELECT sum(x.n) FROM nb x WHERE x.batch_id > b2.batch_id AND x.batch_id < b.batch_id), 0) AS off
          FROM nb b JOIN nb b2 ON b2.batch_id < b.batch_id),
qk AS (SELECT p.b AS batch_id, a.t FROM pairs p JOIN a ON a.batch_id = p.b2 WHERE p.off + a.i < 40),
keys AS (SELECT batch_id, t FROM qk UNION ALL SELECT batch_id, t FROM a),
zz AS (SELECT q.batch_id, q.i, list_cosine_similarity(q.s, k.t) / 0.05 AS z FROM a q JOIN keys k USING (batch_id)),
{_lse('z')},
tg AS (SELECT batch_id, i, list_cosine_similarity(s, t) / 0.05 AS zt FROM a)
SELECT tg.batch_id, round(avg(lse.lse - tg.zt), 6) AS loss, (SELECT count(*) FROM qk WHERE qk.batch_id = tg.batch_id) AS queue_rows
FROM tg JOIN lse USING (batch_id, i) GROUP BY tg.batch_id"""


@register("loss_ckd_queue", QUEUE_SQL)
def q_loss_ckd_queue(t: Tables):
    return L.loss_ckd_queue(_bv(t, use_pos=False), queue_len=40, batch_rows=16)


TAID_SQL = """WITH RECURSIVE lg AS (
  SELECT user_id % 10 AS run, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) - 1 AS step, value AS loss,
         count(*) OVER (PARTITION BY user_id % 10) AS n FROM events),
r(run, step, t, prev, m, n) AS (
  SELECT run, step, 0.4::DOUBLE, loss, 0.0::DOUBLE, n FROM lg WHERE step = 0
  UNION ALL
  SELECT lg.run, lg.step,
         least(1.0::DOUBLE, greatest(0.4::DOUBLE + (1.0::DOUBLE - 0.4::DOUBLE) * (lg.step / r.n),
               r.t + 5e-4::DOUBLE * (1.0 / (1.0 + exp(-(0.99::DOUBLE * r.m + (1.0::DOUBLE - 0.99::DOUBLE) * ((r.prev - lg.loss) / (r.prev + 1e-15::DOUBLE)))))) * (1.0 - r.t))),
         lg.loss, 0.99::DOUBLE * r.m + (1.0::DOUBLE - 0.99::DOUBLE) * ((r.prev - lg.loss) / (r.prev + 1e-15::DOUBLE)), r.n
  FROM r JOIN lg ON lg.run = r.run AND lg.step = r.step + 1)
SELECT run, step, round(t, 6) AS t, round(m, 6) AS momentum FROM r"""


@register("taid_schedule", TAID_SQL)
def q_taid_schedule(t: Tables):
    from ..operators.indexing import range_row_index
    ev = t.events.select((F.col("user_id") % 10).alias("run"), "ts", "event_id", F.col("value").alias("loss"))
    ev = range_row_index(ev, [("ts", True), ("event_id", True)], out="step", group=["run"])
    # 100-step blocks: the block chaining is part of what the oracle checks
    return L.taid_schedule(ev.select("run", "step", "loss"), block_rows=100)
