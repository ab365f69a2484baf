"""Registered source queries (S2, S4) over lines built from the tables, with SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import first_line
from ..sources import files as FS
from ..sources import tsv_records as TSV
from . import sqltext as S
from .fixtures import Tables
from .registry import register


def label_lines(t: Tables):
    d = t.documents
    good = d.select(F.to_json(F.struct("text", F.col("lang").alias("label"))).alias("value"))
    junk = d.filter(F.col("lang") == "de").select(F.explode(F.array(F.lit(""), F.lit("{broken"), F.lit("   "))).alias("value"))
    return good.unionByName(junk)


@register("read_label_jsonl", f"""WITH lines AS (
  SELECT to_json({{'text': text, 'label': lang}})::VARCHAR AS value FROM documents
  UNION ALL SELECT unnest(['', '{{broken', '   ']) FROM documents WHERE lang = 'de')
SELECT {S.strip("coalesce(json_extract_string(value, '$.text'), '')")} AS text, json_extract_string(value, '$.label') AS label
FROM lines WHERE json_valid(value) AND trim(value) <> '' AND json_type(value) = 'OBJECT'""")
def q_read_label_jsonl(t: Tables):
    return FS.parse_label_lines(label_lines(t))


def tsv_lines(t: Tables):
    d = t.documents
    rec = F.concat_ws("\t", "source", F.concat(F.lit("http://x/"), F.col("doc_id").cast("string")), first_line(F.col("text")),
                      F.lit("none"), "lang", "text", F.col("doc_id").cast("string"), F.lit("0"), F.lit("null"))
    ex = d.select("doc_id", F.posexplode(F.split(rec, "\n")).alias("i", "line"))
    return ex.select(F.lit("news").alias("file"), F.struct("doc_id", "i").alias("line_no"), "line")


@register("parse_multiline_tsv", f"""SELECT 'news' AS file, row_number() OVER (ORDER BY doc_id) - 1 AS record, source,
  'http://x/' || doc_id AS url, {S.strip(S.first_line('text'))} AS title, {S.strip('lang')} AS category,
  {S.strip("replace(text, '\\' || chr(10), chr(10))")} AS content, CAST(doc_id AS VARCHAR) AS label_id, '0' AS ts,
  true AS label_is_int FROM documents""")
def q_parse_multiline_tsv(t: Tables):
    return TSV.parse_multiline_tsv(tsv_lines(t), block_lines=5000)
