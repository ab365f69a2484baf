"""Registered text-function queries (P7–P13, P17, P18) and SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import pairs as P
from ..operators import stats as ST
from ..operators import textops as TO
from . import sqltext as S
from .fixtures import INSTR_SQL, PAIR_SQL, Tables, instructions, pairs
from .registry import register

SEED = 42


@register("title_text", f"""SELECT doc_id,
  {S.first_line('text')} || ' ' || {S.rest_lines('text')} AS raw,
  {S.strip(S.first_line('text') + " || ' ' || " + S.rest_lines('text'))} AS stripped,
  {S.strip(S.first_line('text'))} || ' ' || {S.strip(S.rest_lines('text'))} AS strip_both
FROM documents WHERE strpos(text, chr(10)) > 0""")
def q_title_text(t: Tables):
    d = t.documents.filter(F.instr("text", "\n") > 0)
    ti, tx = TX.first_line(F.col("text")), TX.rest_lines(F.col("text"))
    return d.select("doc_id", TO.title_text(ti, tx, "raw").alias("raw"), TO.title_text(ti, tx, "strip").alias("stripped"),
                    TO.title_text(ti, tx, "strip_both").alias("strip_both"))


INSTRUCT_SQL = "CASE WHEN length(coalesce(i.instruction, '')) > 0 THEN 'Instruct:' || i.instruction || chr(10) || 'Query:' || p.anc ELSE p.anc END"


@register("instruction_prefix", f"""WITH {PAIR_SQL}, {INSTR_SQL}
SELECT p.subset, p.id, {INSTRUCT_SQL} AS text FROM pair p LEFT JOIN instr i USING (subset)""")
def q_instruction_prefix(t: Tables):
    p = P.with_instruction(pairs(t), instructions(t))
    return p.select("subset", "id", P.instruct(F.col("anc"), F.col("instruction")).alias("text"))


@register("instruction_strip", f"""WITH {PAIR_SQL}, {INSTR_SQL},
x AS (SELECT p.subset, p.id, {INSTRUCT_SQL} || CASE WHEN p.label = 'fr' THEN ' Query: tail' ELSE '' END AS t
      FROM pair p LEFT JOIN instr i USING (subset))
SELECT subset, id,
  CASE WHEN strpos(t, 'Query:') > 0 THEN {S.strip("substr(t, strpos(t, 'Query:') + 6)")} ELSE t END AS after_first,
  CASE WHEN starts_with(t, 'Instruct:') THEN
       CASE WHEN len(string_split(t, 'Query:')) > 1 THEN {S.strip("string_split(t, 'Query:')[2]")} ELSE {S.strip('t')} END
       ELSE {S.strip('t')} END AS between
FROM x""")
def q_instruction_strip(t: Tables):
    p = P.with_instruction(pairs(t), instructions(t))
    # French rows get a second "Query:" so the two variants differ
    x = P.instruct(F.col("anc"), F.col("instruction"))
    x = F.concat(x, F.when(F.col("label") == "fr", F.lit(" Query: tail")).otherwise(F.lit("")))
    p = p.select("subset", "id", x.alias("t"))
    return p.select("subset", "id", TO.strip_after_query(F.col("t")).alias("after_first"),
                    TO.normalize_query(F.col("t")).alias("between"))


_MAP_NAMES = sorted(TO.PREFIX_MAP)
_MAP_SQL = "[" + ", ".join(f"'{k}'" for k in _MAP_NAMES) + "]"
_MAP_CASE = " ".join(f"WHEN '{k}' THEN ['{q}', '{d}']" for k, (q, d) in TO.PREFIX_MAP.items())


@register("subset_prefix", f"""WITH {PAIR_SQL},
x AS (SELECT CASE WHEN CAST(substr(subset, 4) AS INT) < {len(_MAP_NAMES)}
                  THEN {_MAP_SQL}[CAST(substr(subset, 4) AS INT) + 1] ELSE subset END AS subset, id, anc, pos FROM pair),
y AS (SELECT *, coalesce(CASE subset {_MAP_CASE} END, ['query:', 'document:']) AS pre FROM x)
SELECT subset, id, pre[1] || ' ' || anc AS anc, pre[2] || ' ' || pos AS pos FROM y""")
def q_subset_prefix(t: Tables):
    p = pairs(t)
    # source number k → the k-th map name (sorted), so both prefix kinds and defaults occur
    k = F.substring("subset", 4, 10).cast("int")
    names = F.array(*[F.lit(n) for n in _MAP_NAMES])
    p = p.withColumn("subset", F.when(k < len(_MAP_NAMES), F.element_at(names, k + 1)).otherwise(F.col("subset")))
    return TO.subset_prefix(p.select("subset", "id", "anc", "pos"))


@register("clean_text", f"""SELECT 'doc' AS kind, doc_id AS id, {S.clean(S.strip('text'))} AS text FROM documents
UNION ALL SELECT 'page', page_id, {S.clean('html', entities=True)} FROM pages
UNION ALL SELECT 'url', page_id, {S.clean("'see ' || url || ' at 2007-03-05 18:10:50, 6:44 PM'")} FROM pages""")
def q_clean_text(t: Tables):
    d = t.documents.select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"),
                           TX.clean_text(TX.py_strip(F.col("text"))).alias("text"))
    pg = t.pages.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), TX.clean_text(F.col("html")).alias("text"))
    u = t.pages.select(F.lit("url").alias("kind"), F.col("page_id").alias("id"),
                       TX.clean_text(F.concat(F.lit("see "), F.col("url"), F.lit(" at 2007-03-05 18:10:50, 6:44 PM"))).alias("text"))
    return d.unionByName(pg).unionByName(u)


@register("valid_text", f"""SELECT doc_id, {S.valid(S.clean(S.strip('text')))} AS valid,
  {S.valid(S.first_line('text'))} AS first_line_valid FROM documents""")
def q_valid_text(t: Tables):
    d = t.documents
    return d.select("doc_id", TX.is_valid_text(TX.clean_text(TX.py_strip(F.col("text")))).alias("valid"),
                    TX.is_valid_text(TX.first_line(F.col("text"))).alias("first_line_valid"))


@register("compose_text", f"""SELECT doc_id,
  CASE WHEN length(coalesce({S.rest_lines('text')}, '')) > 0 THEN {S.first_line('text')} || chr(10) || chr(10) || {S.rest_lines('text')}
       ELSE {S.first_line('text')} END AS text FROM documents""")
def q_compose_text(t: Tables):
    d = t.documents
    return d.select("doc_id", TO.compose_text(TX.first_line(F.col("text")), TX.rest_lines(F.col("text"))).alias("text"))


def _chunk_sql(ratio: float = 0.3, max_lines: int = 10, min_chars: int = 20, seed: int = SEED) -> str:
    H = S.H
    return f"""WITH RECURSIVE
r AS (SELECT doc_id AS key, text, row_number() OVER (ORDER BY {H(seed, "'short'", 'doc_id')}, doc_id) - 1 AS rk FROM documents),
n AS (SELECT count(*) AS n FROM documents),
chosen AS (SELECT key, string_split(text, chr(10)) AS l, len(string_split(text, chr(10))) AS nl
           FROM r, n WHERE rk < floor(n.n * {ratio})),
ch(key, k, i, z) AS (
  SELECT key, 0, 0, CAST(3 + {H(seed, 'key', '0', "'chunk'")} % (least({max_lines}, nl) - 2) AS INT) FROM chosen WHERE 2 < nl
  UNION ALL
  SELECT c.key, ch.k + 1, ch.i + ch.z,
         CAST(3 + {H(seed, 'c.key', 'ch.k + 1', "'chunk'")} % (least({max_lines}, c.nl - (ch.i + ch.z)) - 2) AS INT)
  FROM ch JOIN chosen c ON c.key = ch.key WHERE ch.i + ch.z + 2 < c.nl),
txt AS (SELECT ch.key, ch.k, array_to_string(c.l[ch.i + 1 : ch.i + ch.z], chr(10)) AS t FROM ch JOIN chosen c ON c.key = ch.key),
g AS (SELECT *, sum(CASE WHEN k = 0 OR length(t) >= {min_chars} THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY k) - 1 AS grp FROM txt)
SELECT key AS doc_id, CAST(grp AS BIGINT) AS part, string_agg(t, chr(10) ORDER BY k) AS text FROM g GROUP BY key, grp
UNION ALL
SELECT r.key, -1, r.text FROM r, n WHERE rk >= floor(n.n * {ratio})"""


@register("chunk_lines", _chunk_sql())
def q_chunk_lines(t: Tables):
    return TO.chunk_lines(t.documents, "doc_id", "text", ratio=0.3, seed=SEED)


@register("length_buckets", f"""WITH {PAIR_SQL}, {INSTR_SQL},
flat AS (SELECT length({INSTRUCT_SQL}) AS len FROM pair p LEFT JOIN instr i USING (subset)
         UNION ALL SELECT length(pos) FROM pair)
SELECT CASE WHEN len > 512 THEN 'long' WHEN len > 128 THEN 'medium' ELSE 'short' END AS bucket, count(*) AS rows
FROM flat GROUP BY 1""")
def q_length_buckets(t: Tables):
    flat = P.flatten_pairs(pairs(t), instructions(t))
    return ST.length_buckets(flat, "len", 512, 128).groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"))


PROMPTS = {"query": "query: ", "passage": "document: "}


@register("prompt_variants", f"""WITH {PAIR_SQL},
p AS (SELECT * FROM (VALUES ('passage', 'document: '), ('query', 'query: ')) v(prompt_name, prompt))
SELECT pair.subset, pair.id, p.prompt_name, p.prompt || pair.anc AS prompted FROM pair, p""")
def q_prompt_variants(t: Tables):
    p = pairs(t).select("subset", "id", F.col("anc").alias("text"))
    return TO.prompt_variants(p, PROMPTS).select("subset", "id", "prompt_name", "prompted")
