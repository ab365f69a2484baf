"""Registered shaping queries (S1, P1–P4, P6, P14–P16) and SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import shaping as SH
from .fixtures import CONV_SQL, LINES_SQL, PAIR_SQL, Tables, conv_qa, jsonl_lines, pairs
from .registry import register

SHAPED_SQL = f"""WITH {LINES_SQL},
shaped AS (SELECT file, line_no, value,
                  CASE WHEN starts_with(trim(value), '[') THEN 'list'
                       ELSE array_to_string(list_sort(json_keys(value)), ',') END AS rs FROM lines),
firsts AS (SELECT file, arg_min(rs, line_no) AS fs FROM shaped GROUP BY file),
j AS (SELECT s.file, s.line_no, s.value, f.fs FROM shaped s JOIN firsts f USING (file)),
l AS (SELECT file, line_no, CAST(value AS JSON)::VARCHAR[] AS a FROM j WHERE fs = 'list'),
s AS (SELECT file, line_no, CAST(json_extract(value, '$.set') AS VARCHAR[]) AS a FROM j WHERE fs = 'set'),
q AS (SELECT file, line_no, json_extract_string(value, '$.query') AS query,
             CAST(json_extract(value, '$.pos') AS VARCHAR[]) AS p,
             CAST(json_extract(value, '$.neg') AS VARCHAR[]) AS n, fs FROM j WHERE fs IN ('pos,query', 'neg,pos,query')),
se AS (SELECT file, line_no, a, unnest(range(0, len(a) // 2)) AS i FROM s),
qe AS (SELECT file, line_no, query, p, n, fs, unnest(range(0, len(p))) AS i FROM q),
items AS (
  SELECT file, line_no, 0 AS item, a[1] AS anc, a[2] AS pos, CASE WHEN len(a) > 2 THEN a[3] END AS neg FROM l
  UNION ALL SELECT file, line_no, i, a[i + 1], a[i + 2], NULL FROM se
  UNION ALL SELECT file, line_no, i, query, p[i + 1],
                   CASE WHEN fs = 'neg,pos,query' AND len(n) > 0 THEN n[least(i, len(n) - 1) + 1] END FROM qe)"""


def _shaped(t: Tables):
    return SH.shape_jsonl(jsonl_lines(t))


@register("read_shaped_jsonl", SHAPED_SQL + "\nSELECT file, line_no, CAST(item AS BIGINT) AS item, anc, pos, neg FROM items")
def q_read_shaped(t: Tables):
    return _shaped(t)


for _name, _file in [("shape_list", "list_triples"), ("shape_set", "sets"), ("shape_query_pos", "qpos"),
                     ("shape_query_pos_neg", "qposneg")]:
    register(_name, SHAPED_SQL + f"\nSELECT line_no, CAST(item AS BIGINT) AS item, anc, pos, neg FROM items WHERE file = '{_file}'")(
        lambda t, _f=_file: _shaped(t).filter(F.col("file") == _f).drop("file"))


@register("selected_passages", f"""WITH {CONV_SQL},
ms AS (SELECT conv_id AS query_id, query, answers AS passage_text,
              list_transform(range(0, len(answers)), lambda i: CASE WHEN i = 0 THEN 1 ELSE 0 END) AS is_selected FROM conv),
z AS (SELECT query_id, query, unnest(passage_text) AS t, unnest(is_selected) AS s FROM ms)
SELECT query_id, query AS anc, t AS pos FROM z WHERE s = 1""")
def q_selected_passages(t: Tables):
    qa = conv_qa(t)
    ms = qa.select(F.col("conv_id").alias("query_id"), "query", F.struct(
        F.col("answers").alias("passage_text"),
        F.transform("answers", lambda x, i: F.when(i == 0, 1).otherwise(0)).alias("is_selected")).alias("passages"))
    return SH.selected_passages(ms)


@register("triplet_schema", f"""WITH {LINES_SQL}
SELECT coalesce(nullif(json_extract_string(value, '$.query'), ''), '') AS anc,
       coalesce(nullif(json_extract_string(value, '$.pos[0]'), ''), '') AS pos,
       coalesce(CAST(json_extract(value, '$.neg') AS VARCHAR[]), CAST([] AS VARCHAR[])) AS neg,
       '' AS label, file AS subset
FROM lines WHERE file IN ('qpos', 'qposneg')""")
def q_triplet_schema(t: Tables):
    raw = jsonl_lines(t).filter(F.col("file").isin("qpos", "qposneg"))
    parsed = raw.select(F.col("file").alias("subset"),
                        F.from_json("value", "struct<query: string, pos: array<string>, neg: array<string>>").alias("_o"))
    rec = parsed.select("subset", F.col("_o.query").alias("query"), F.try_element_at("_o.pos", F.lit(1)).alias("document"),
                        F.col("_o.neg").alias("neg"))
    return SH.triplet_schema(rec)


@register("column_fallback", f"""WITH {PAIR_SQL}
SELECT coalesce(nullif(CASE WHEN label = 'en' THEN anc END, ''), CASE WHEN label <> 'en' THEN anc END, '') AS anc,
       coalesce(nullif(pos, ''), '') AS pos, CAST([] AS VARCHAR[]) AS neg, '' AS label, subset FROM pair""")
def q_column_fallback(t: Tables):
    p = pairs(t)
    # English rows carry the text in ``anc``, the others in ``query`` (two source layouts)
    rec = p.select(F.when(F.col("label") == "en", F.col("anc")).alias("anc"),
                   F.when(F.col("label") != "en", F.col("anc")).alias("query"), "pos", "subset")
    return SH.triplet_schema(rec, pair_only=True)


LENIENT_SRC = """CASE lang WHEN 'en' THEN to_json(string_split(text, chr(10)))::VARCHAR WHEN 'fr' THEN ''
                 WHEN 'de' THEN NULL ELSE '"x"' END"""


@register("lenient_list", f"""SELECT doc_id,
  CASE WHEN json_valid(v) AND json_type(v) = 'ARRAY' THEN CAST(v AS JSON)::VARCHAR[] ELSE CAST([] AS VARCHAR[]) END AS items
FROM (SELECT doc_id, {LENIENT_SRC} AS v FROM documents)""")
def q_lenient_list(t: Tables):
    d = t.documents
    v = (F.when(F.col("lang") == "en", F.to_json(F.split("text", "\n"))).when(F.col("lang") == "fr", F.lit(""))
         .when(F.col("lang") == "de", F.lit(None).cast("string")).otherwise(F.lit('"x"')))
    return d.select("doc_id", SH.lenient_list(v).alias("items"))
