"""Registered queries of file sources and sinks (S3, S5–S9, S11, S12, W5): the tables are written in the source's form to the
shared folder and read back through the reader, with SQL oracles over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import first_line, rest_lines
from ..operators import vectors as VO
from ..operators.ordering import first_rows
from ..session import shared_path
from ..sources import files as FS
from . import sqltext as S
from .fixtures import Tables
from .registry import register

# Spark names the folder of a NULL partition value so
SOURCE_DIR = "'source=' || coalesce(source, '__HIVE_DEFAULT_PARTITION__')"


@register("read_qa_csv", f"""SELECT lang AS label, {S.first_line('text')} AS q_title, coalesce({S.rest_lines('text')}, 'none') AS q_body,
  source || ' says "' || doc_id || '"' AS answer FROM documents WHERE length(trim(text)) > 0""")
def q_read_qa_csv(t: Tables):
    d = t.documents.where(F.length(F.trim("text")) > 0)
    says = F.concat("source", F.lit(' says "'), F.col("doc_id").cast("string"), F.lit('"'))
    rows = d.select("lang", first_line(F.col("text")), F.coalesce(rest_lines(F.col("text")), F.lit("none")), says)
    path = shared_path(t.spark, "qa-csv")
    rows.write.option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).csv(path)
    return FS.read_qa_csv(t.spark, path)


@register("read_source_dirs", f"SELECT text AS anc, lang AS pos, {SOURCE_DIR} AS source FROM documents")
def q_read_source_dirs(t: Tables):
    path = shared_path(t.spark, "source-dirs")
    rows = t.documents.select("source", F.col("text").alias("query"), F.array("lang", F.lit("second")).alias("pos"))
    rows.write.partitionBy("source").json(path)
    return FS.read_source_dirs(t.spark, path, pattern="*.json")


@register("csv_union", f"""SELECT {SOURCE_DIR} AS model_path, CAST(doc_id AS VARCHAR) AS doc_id, lang,
  CASE WHEN doc_id % 2 = 1 THEN CAST(n_chars AS VARCHAR) END AS n_chars FROM documents""")
def q_csv_union(t: Tables):
    """Files of two headers: other columns in another order, by the parity of the id."""
    path = shared_path(t.spark, "csv-tree")
    d = t.documents
    even, odd = d.where("doc_id % 2 = 0").select("source", "doc_id", "lang"), d.where("doc_id % 2 = 1").select("source", "lang", "n_chars", "doc_id")
    even.write.partitionBy("source").option("header", True).csv(f"{path}/even")
    odd.write.partitionBy("source").option("header", True).csv(f"{path}/odd")
    return FS.csv_union_with_path(t.spark, path, "*.csv")


@register("dataset_roundtrip", "SELECT doc_id AS id, text AS anc, source AS subset FROM documents")
def q_dataset_roundtrip(t: Tables):
    path = shared_path(t.spark, "dataset")
    FS.write_dataset(t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("anc"), F.col("source").alias("subset")), path)
    return t.spark.read.parquet(path)


@register("embeddings_roundtrip", "SELECT vec_id AS emb_idx, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings")
def q_embeddings_roundtrip(t: Tables):
    path = shared_path(t.spark, "embeddings")
    v = F.col("embedding").cast("array<double>")
    FS.write_embeddings(t.embeddings.select(F.col("vec_id").alias("emb_idx"), v.alias("embedding")), path, rows_per_file=1000)
    return t.spark.read.parquet(path)


@register("summary_json", "SELECT lang, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY lang")
def q_summary_json(t: Tables):
    path = shared_path(t.spark, "summary")
    FS.write_summary_json(t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")), path)
    return t.spark.read.schema("lang string, n long, chars long").json(path)


@register("jsonl_roundtrip", "SELECT text, lang AS label FROM documents")
def q_jsonl_roundtrip(t: Tables):
    path = shared_path(t.spark, "jsonl")
    FS.write_jsonl(t.documents.select("text", F.col("lang").alias("label")), path)
    return t.spark.read.schema("text string, label string").json(path)


@register("resolve_version", """SELECT 'exact' AS asked, d.doc_id, false AS to_sample FROM documents d WHERE doc_id % 2 = 0
UNION ALL SELECT 'smaller', d.doc_id, true FROM documents d""")
def q_resolve_version(t: Tables):
    """Two versions of the table under their sizes: one asked for by its size, one by a size between both."""
    path, d = shared_path(t.spark, "versions"), t.documents.select("doc_id")
    half, n = d.where("doc_id % 2 = 0"), d.count()
    k = half.count()
    d.write.parquet(f"{path}/{n}")
    half.write.parquet(f"{path}/{k}")
    out = None
    for asked, size in (("exact", k), ("smaller", n - 1)):
        folder, rows = FS.resolve_version(t.spark, path, size)
        part = t.spark.read.parquet(folder).select(F.lit(asked).alias("asked"), "doc_id", F.lit(rows is not None).alias("to_sample"))
        out = part if out is None else out.unionByName(part)
    return out


@register("first_rows", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100")
def q_first_rows(t: Tables):
    return first_rows(t.documents.select("doc_id", "lang"), 100, "doc_id")


@register("lookup_vector_store", """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT a.vec_id AS id, round(list_sum(a.v), 6) AS own, round(list_sum(b.v), 6) AS next,
       list_filter([round(list_sum(c.v), 6), round(list_sum(d.v), 6)], lambda x: x IS NOT NULL) AS negs
FROM e a LEFT JOIN e b ON b.vec_id = a.vec_id + 1 LEFT JOIN e c ON c.vec_id = a.vec_id + 7 LEFT JOIN e d ON d.vec_id = a.vec_id - 7""")
def q_lookup_vector_store(t: Tables):
    emb = t.embeddings.select(F.col("vec_id").alias("emb_idx"), F.col("embedding").cast("array<double>").alias("embedding"))
    path = shared_path(t.spark, "vectors")
    store = FS.write_vector_store(emb, "pairloom_" + path.rsplit("-", 1)[1], path, buckets=16)
    rows = t.embeddings.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("anc_emb_idx"), (F.col("vec_id") + 1).alias("pos_emb_idx"),
                               F.array(F.col("vec_id") + 7, F.col("vec_id") - 7).alias("neg_emb_idx"))
    out = VO.lookup_vectors(rows, store, key=("id",))
    s = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 6)
    return out.select("id", s(F.col("anc_emb_idx_vec")).alias("own"), s(F.col("pos_emb_idx_vec")).alias("next"), F.transform("neg_vecs", s).alias("negs"))
