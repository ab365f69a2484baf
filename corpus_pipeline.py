"""A training corpus from documents: quality, toxicity, line deduplication, near-duplicates, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of ``documents``. Each stage works on every row that the stage before it kept.

Null, empty and very long texts, null ids, repeated rows and ties have the results that the operators' modules state: null and empty texts pass quality,
toxicity and line deduplication, and all of them are one class of near-duplicates, of which one row stays. Rows without an id are documents like others. Columns of any name pass
unchanged; empty tables give empty tables, and without labels nothing is rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.common import shared_folder, table
from pairloom.llm.kn_quality import keep_good
from pairloom.llm.line_templates import drop_templates
from pairloom.llm.near_join import one_of_each
from pairloom.llm.packing import byte_length, pack
from pairloom.llm.toxicity import drop_toxic


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose perplexity is above their language's threshold."""
    return keep_good(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the toxicity classifier predicts."""
    return drop_toxic(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops recurring lines, and documents that had text and have none left; ``n_chars`` follows the text."""
    names = {c: f"__doc_{i}" for i, c in enumerate(docs.columns)}
    out = drop_templates(docs.toDF(*names.values()), names["doc_id"], names["text"])
    text = F.col(names["text"])
    emptied = (F.size("__dropped") > 0) & (F.trim(F.translate(text, "\n\r\t", "   ")) == "")
    changed = F.when(F.size("__dropped") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(names["n_chars"])) if "n_chars" in names else None
    return out.where(~emptied).select(*[(changed if c == "n_chars" else F.col(n)).alias(c) for c, n in names.items()])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates."""
    return one_of_each(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents, as bytes with an end mark, into sequences."""
    return pack(docs, byte_length())


STAGES = [("quality", quality), ("toxicity", toxicity), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("packing", packing)]

#: SQL can't express the language model, the classifier and the packing; tests/llm/test_pipeline.py compares the stages with plain Python on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
