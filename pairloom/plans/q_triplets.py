"""Registered triplet queries (M1–M5) and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pairs as P
from ..operators import stats as ST
from ..operators import triplets as TR
from . import sqltext as S
from ..functions import text as TX
from .fixtures import LINES_SQL, Tables, jsonl_lines
from .registry import register

SEED = 42
NUM_NEGS = 7
POS_TRIES = 20


def floyd_sql(name: str, src: str, size: str, m: str, steps: int, draw) -> str:
    """CTE ``name``: ``src`` with ``s``, a list of ``m`` (at most ``steps``) distinct numbers below ``size`` by Floyd's method."""
    ctes = [f"{name}_0 AS (SELECT *, CAST([] AS BIGINT[]) AS s FROM {src})"]
    for c in range(1, steps + 1):
        t = f"{draw(c)} % greatest({size} - {m} + {c}, 1)"
        ctes.append(f"""{name}_{c} AS (SELECT * REPLACE (CASE WHEN {c} > {m} THEN s
            WHEN list_contains(s, {t}) THEN list_append(s, {size} - {m} + {c - 1}) ELSE list_append(s, {t}) END AS s) FROM {name}_{c - 1})""")
    return ",\n".join([*ctes, f"{name} AS (SELECT * FROM {name}_{steps})"])


POOL_SQL = """pool AS (SELECT *, sha256(text) AS th, row_number() OVER (ORDER BY label NULLS FIRST, sha256(text), key NULLS FIRST) - 1 AS gi FROM valid),
labs AS (SELECT label, min(gi) AS off, count(*) AS n, row_number() OVER (ORDER BY min(gi)) - 1 AS lno FROM pool GROUP BY label),
tot AS (SELECT count(*) AS L FROM labs),
num AS (SELECT p.gi, p.th, l.lno, l.off, l.n FROM pool p JOIN labs l ON p.label IS NOT DISTINCT FROM l.label),
runs AS (SELECT th, lno, min(gi) AS start, count(*) AS cnt FROM num GROUP BY th, lno)"""


def negatives_sql(num_negs: int, seed: int) -> str:
    """From ``num``, ``runs``, ``labs``, ``tot`` and ``exth(gi, th)`` (texts that an anchor excludes) to ``negs(gi, neg)``."""
    h = S.H60
    return f"""lab_runs AS (SELECT e.gi, r.lno, sum(r.cnt)::BIGINT AS c, list({{'start': r.start, 'cnt': r.cnt}} ORDER BY r.start) AS rs
             FROM exth e JOIN runs r USING (th) GROUP BY e.gi, r.lno),
dr AS (SELECT a.gi, a.lno AS own, {h(seed, 'a.gi', 't.d', "'lab'")} % (tot.L - 1) AS o
       FROM num a CROSS JOIN range(0, {num_negs}) t(d) CROSS JOIN tot WHERE tot.L > 1),
dl AS (SELECT gi, o + CASE WHEN o >= own THEN 1 ELSE 0 END AS lno, count(*) AS m FROM dr GROUP BY ALL),
pe AS (SELECT dl.gi, dl.lno, l.off, dl.m, l.n - coalesce(x.c, 0) AS u, least(dl.m, l.n - coalesce(x.c, 0)) AS take, x.rs
       FROM dl JOIN labs l USING (lno) LEFT JOIN lab_runs x ON x.gi = dl.gi AND x.lno = dl.lno),
{floyd_sql('fl', 'pe', 'u', 'take', num_negs, lambda c: h(seed, 'gi', 'lno', str(c), "'idx'"))},
p0 AS (SELECT gi, rs, off + unnest(s) AS g FROM fl),
p1 AS (SELECT gi, rs, CASE WHEN g >= rs[1].start THEN g + rs[1].cnt ELSE g END AS g FROM p0),
pk AS (SELECT gi, CASE WHEN g >= rs[2].start THEN g + rs[2].cnt ELSE g END AS g FROM p1),
ov AS (SELECT gi, sum(m - take)::BIGINT AS over FROM pe GROUP BY gi HAVING sum(m - take) > 0),
rest AS (SELECT ov.gi, ov.over, p.gi AS g, row_number() OVER (PARTITION BY ov.gi ORDER BY p.gi) - 1 AS x
         FROM ov JOIN num a USING (gi) JOIN num p ON p.lno <> a.lno ANTI JOIN exth e ON e.gi = ov.gi AND e.th = p.th
         ANTI JOIN pk ON pk.gi = ov.gi AND pk.g = p.gi),
re AS (SELECT gi, count(*) AS l, least(any_value(over), count(*)) AS e FROM rest GROUP BY gi),
{floyd_sql('fi', 're', 'l', 'e', num_negs, lambda c: h(seed, 'gi', str(c), "'fill'"))},
fx AS (SELECT gi, unnest(s) AS x FROM fi),
picked AS (SELECT gi, g FROM pk UNION ALL SELECT gi, rest.g FROM fx JOIN rest USING (gi, x)),
negs AS (SELECT k.gi, list(p.text ORDER BY {h(seed, 'k.gi', 'k.g', "'ord'")}, k.g) AS neg FROM picked k JOIN pool p ON p.gi = k.g GROUP BY k.gi)"""


def label_triplets_sql(src_cte: str, num_negs: int = NUM_NEGS, seed: int = SEED, pos_tries: int = POS_TRIES) -> str:
    """CTEs ending in ``trip(key, anc, pos, neg, label, subset)`` replaying label-pool sampling.

    ``src_cte`` defines ``src(key, text, label, subset)`` (raw text).
    """
    return f"""{src_cte},
cleaned AS (SELECT key, {S.clean(S.strip("text"))} AS text, CAST(label AS VARCHAR) AS label, subset FROM src),
valid AS (SELECT * FROM cleaned WHERE {S.valid('text')}),
{POOL_SQL},
own AS (SELECT num.*, r.start, r.cnt, num.off + {S.H60(seed, 'num.gi', "'pos'")} % greatest(num.n - r.cnt, 1) AS x FROM num JOIN runs r USING (th, lno)),
ps AS (SELECT gi, th, CASE WHEN n = cnt OR {S.H(seed, 'gi', "'own'")} < pow(cnt::DOUBLE / n, {pos_tries}) * 4294967296 THEN gi
                           WHEN x >= start THEN x + cnt ELSE x END AS p FROM own),
exth AS (SELECT gi, th FROM ps UNION SELECT ps.gi, q.th FROM ps JOIN num q ON q.gi = ps.p),
{negatives_sql(num_negs, seed)},
trip AS (SELECT a.key, a.text AS anc, p.text AS pos, coalesce(negs.neg, CAST([] AS VARCHAR[])) AS neg, a.label, a.subset
         FROM pool a JOIN ps USING (gi) JOIN pool p ON p.gi = ps.p LEFT JOIN negs ON negs.gi = a.gi)"""


DOC_SRC = "src AS (SELECT doc_id AS key, text, lang AS label, source AS subset FROM documents)"


def _doc_triplets(t: Tables):
    return TR.triplets_by_label(t.documents, key="doc_id", text="text", label="lang", num_negs=NUM_NEGS, seed=SEED,
                                pos_tries=POS_TRIES, carry=("source",))


@register("triplets_by_label", f"""WITH {label_triplets_sql(DOC_SRC)}
SELECT key AS doc_id, anc, pos, neg, label, subset AS source FROM trip""")
def q_triplets_by_label(t: Tables):
    return _doc_triplets(t)


FLAT_STATS_SQL = f"""WITH {label_triplets_sql(DOC_SRC)},
flat AS (
  SELECT anc AS text, 'anc' AS "column" FROM trip
  UNION ALL SELECT pos, 'pos' FROM trip
  UNION ALL SELECT unnest(neg), 'neg' FROM trip)
SELECT "column", count(*) AS count, min(length(text)) AS min, max(length(text)) AS max,
       round(avg(length(text)), 6) AS mean, round(quantile_cont(length(text), 0.5), 6) AS median,
       round(stddev_pop(length(text)), 6) AS std, round(quantile_cont(length(text), 0.25), 6) AS p25,
       round(quantile_cont(length(text), 0.75), 6) AS p75
FROM flat GROUP BY "column\""""


def flagship(t: Tables):
    """documents → clean → valid → label triplets → flatten → length stats per column."""
    trip = _doc_triplets(t).select("anc", "pos", "neg", "label", F.col("source").alias("subset"),
                                   F.col("doc_id").alias("id"))
    flat = P.flatten_triplets(trip)
    return ST.length_stats(flat, "len", ["column"])


register("triplet_length_stats", FLAT_STATS_SQL)(flagship)


def given_pos_sql(src_cte: str, num_negs: int = NUM_NEGS, seed: int = SEED) -> str:
    """CTEs ending in ``trip`` for M2/M3: ``src(key, anc, pos, label, subset)`` with raw texts (cleaned here)."""
    return f"""{src_cte},
cleaned AS (SELECT key, {S.clean('anc')} AS anc, {S.clean('pos')} AS pos, CAST(label AS VARCHAR) AS label, subset FROM src),
valid AS (SELECT *, pos AS text FROM cleaned WHERE {S.valid('anc')} AND {S.valid('pos')}),
{POOL_SQL},
exth AS (SELECT gi, th FROM num),
{negatives_sql(num_negs, seed)},
trip AS (SELECT a.key, a.anc, a.pos, coalesce(negs.neg, CAST([] AS VARCHAR[])) AS neg, a.label, a.subset FROM pool a LEFT JOIN negs USING (gi))"""


TITLE_SRC = f"""src AS (SELECT doc_id AS key, {S.strip(S.first_line('text'))} AS anc, coalesce({S.rest_lines('text')}, '') AS pos,
                      lang AS label, source AS subset FROM documents)"""


@register("triplets_title_body", f"WITH {given_pos_sql(TITLE_SRC)} SELECT key AS doc_id, anc, pos, neg, label FROM trip")
def q_triplets_title_body(t: Tables):
    from ..functions.text import first_line, rest_lines
    d = t.documents.select("doc_id", TX.py_strip(first_line(F.col("text"))).alias("title"),
                           F.coalesce(rest_lines(F.col("text")), F.lit("")).alias("content"), "lang")
    return TR.triplets_given_pos(d, "doc_id", "title", "content", "lang", NUM_NEGS, SEED)


QA_SRC = f"""qa AS (SELECT u.conv_id, u.turn, u.text AS q, a.text AS answer FROM conversations u
              JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'),
src AS (SELECT conv_id * 1000 + turn AS key,
               CASE WHEN length({S.clean(S.rest_lines('q'))}) > 0
                    THEN {S.clean(S.first_line('q'))} || chr(10) || chr(10) || {S.clean(S.rest_lines('q'))}
                    ELSE {S.clean(S.first_line('q'))} END AS anc,
               answer AS pos, CAST(conv_id % 5 AS VARCHAR) AS label, '' AS subset FROM qa)"""


@register("triplets_qa", f"WITH {given_pos_sql(QA_SRC)} SELECT key, anc, pos, neg, label FROM trip")
def q_triplets_qa(t: Tables):
    from ..functions.text import clean_text, first_line, rest_lines
    from ..operators.textops import compose_text
    c = t.conversations
    u = c.filter(F.col("role") == "user").alias("u")
    a = c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    qa = u.join(a, ["conv_id", "turn"])
    title, body = clean_text(first_line(F.col("text"))), clean_text(rest_lines(F.col("text")))
    qa = qa.select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), compose_text(title, body).alias("anc"),
                   "answer", (F.col("conv_id") % 5).cast("string").alias("label"))
    return TR.triplets_given_pos(qa, "key", "anc", "answer", "label", NUM_NEGS, SEED)


def row_uniform_sql(num_negs: int = NUM_NEGS, seed: int = SEED) -> str:
    K = num_negs
    h = S.H60
    return f"""WITH base AS (SELECT doc_id AS key, {S.strip("coalesce(text, '')")} AS text, lang AS label,
                       row_number() OVER (ORDER BY lang NULLS FIRST, doc_id NULLS FIRST) - 1 AS gi FROM documents),
n AS (SELECT count(*) AS n FROM base),
kb AS (SELECT *, row_number() OVER (ORDER BY key NULLS FIRST, gi) - 1 AS kn FROM base),
b2 AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY gi) - 1 AS lp, count(*) OVER (PARTITION BY label) AS nl FROM kb),
pj AS (SELECT *, {h(seed, 'gi', "'pos'")} % greatest(nl - 1, 1) AS j FROM b2),
pp AS (SELECT p.*, CASE WHEN nl = 1 THEN lp ELSE j + CASE WHEN j >= lp THEN 1 ELSE 0 END END AS plp FROM pj p),
wp AS (SELECT pp.key, pp.gi, pp.kn, pp.text, pp.label, q.text AS pos FROM pp JOIN b2 q ON q.label IS NOT DISTINCT FROM pp.label AND q.lp = pp.plp),
dr AS (SELECT w.gi, w.label, t.d, {h(seed, 'w.gi', 't.d', "'neg'")} % n.n AS j FROM wp w CROSS JOIN range(0, {21 * K}) t(d) CROSS JOIN n),
dl AS (SELECT dr.*, (dr.j <> dr.gi AND b.label IS DISTINCT FROM dr.label) AS ok FROM dr JOIN base b ON b.gi = dr.j),
df AS (SELECT *, ok AND d = min(CASE WHEN ok THEN d END) OVER (PARTITION BY gi, j) AS fv FROM dl),
dc AS (SELECT *, coalesce(sum(CASE WHEN fv THEN 1 ELSE 0 END) OVER (PARTITION BY gi ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS acc_b FROM df),
acc AS (SELECT gi, d, j FROM dc WHERE fv AND acc_b < {K} AND (d - acc_b) < {20 * K}),
got AS (SELECT a.gi, list(b.text ORDER BY a.d) AS neg FROM acc a JOIN base b ON b.gi = a.j GROUP BY a.gi),
o AS (SELECT w.*, coalesce(g.neg, CAST([] AS VARCHAR[])) AS neg0, (w.kn - 1 + n.n) % n.n AS pk FROM wp w LEFT JOIN got g USING (gi) CROSS JOIN n)
SELECT o.key AS doc_id, o.text AS anc, o.pos, list_concat(o.neg0, list_transform(range(0, greatest({K} - len(o.neg0), 0)), lambda x: b.text)) AS neg, o.label
FROM o JOIN kb b ON b.kn = o.pk"""


@register("triplets_row_uniform", row_uniform_sql())
def q_triplets_row_uniform(t: Tables):
    return TR.triplets_row_uniform(t.documents, "doc_id", "text", "lang", NUM_NEGS, SEED)


@register("first_triplet", f"""WITH {LINES_SQL}
SELECT {S.strip("json_extract_string(value, '$.query')")} AS anc, {S.strip("json_extract_string(value, '$.pos[0]')")} AS pos,
       {S.strip("json_extract_string(value, '$.neg[0]')")} AS neg FROM lines WHERE file = 'qposneg'""")
def q_first_triplet(t: Tables):
    raw = jsonl_lines(t).filter(F.col("file") == "qposneg")
    o = raw.select(F.from_json("value", "struct<query: string, pos: array<string>, neg: array<string>>").alias("_o"))
    return TR.first_triplet(o.select("_o.*"))
