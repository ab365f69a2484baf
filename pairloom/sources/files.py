"""File readers (S2, S3, S5, S9, S10, S11, task lists) and sinks."""

from __future__ import annotations

import os
import posixpath
import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import py_strip
from ..session import cut_lineage

MAX_BROADCAST_FILES = 100_000
QA_CSV_SCHEMA = "label string, q_title string, q_body string, answer string"


def parse_label_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """JSONL lines → (text, label): blank or undecodable lines are skipped, text stripped, label as string."""
    v = F.col(value)
    j = F.from_json(v, "struct<text: string, label: string>", {"mode": "PERMISSIVE"})
    ok = (F.length(py_strip(F.coalesce(v, F.lit("")))) > 0) & F.coalesce(F.json_object_keys(v).isNotNull(), F.lit(False))
    d = lines.filter(ok).select(j.alias("_j"))
    return d.select(py_strip(F.coalesce(F.col("_j.text"), F.lit(""))).alias("text"), F.col("_j.label").alias("label"))


def read_label_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """S2 on files: Spark's text reader keeps bad UTF-8 bytes as U+FFFD replacements."""
    return parse_label_lines(spark.read.text(path))


def read_qa_csv(spark: SparkSession, path: str) -> DataFrame:
    """S3: headerless ``label,q_title,q_body,answer`` CSV; quoted fields may hold newlines."""
    return (spark.read.schema(QA_CSV_SCHEMA).option("header", False).option("multiLine", True)
            .option("quote", '"').option("escape", '"').csv(path))


def with_source_dir(df: DataFrame, out: str = "source") -> DataFrame:
    """The name of the folder holding each row's file."""
    return df.withColumn(out, F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))


def read_source_dirs(spark: SparkSession, root: str, seed: int = 42, pattern: str = "*.jsonl") -> DataFrame:
    """``root/<source>/<pattern>`` rows (query, pos[]) → (anc, pos = first positive, source), hash-shuffled."""
    from ..functions.hashing import h

    d = spark.read.schema("query string, pos array<string>").json(os.path.join(root, "*", pattern))
    d = with_source_dir(d.select("*", "_metadata"))
    d = d.select(F.col("query").alias("anc"), F.try_element_at("pos", F.lit(1)).alias("pos"), "source")
    return d.orderBy(h(seed, "src", F.col("source"), F.col("anc"), F.col("pos")), "source", "anc", "pos")


def _header_names(line: Column, width: int) -> Column:
    """Names in a CSV header line; an empty or repeated name gets its place, as Spark's own reader does."""
    end = "\u0001"  # a field behind the last one tells where the line ends: quoted names may hold commas
    fields = F.from_csv(F.concat(line, F.lit(f",{end}")), ", ".join(f"c{i} string" for i in range(width + 1)))
    names = F.array(*[fields[f"c{i}"] for i in range(width + 1)])
    names = F.slice(names, F.lit(1), F.array_position(names, end).cast("int") - 1)
    named = F.transform(names, lambda x, i: F.coalesce(F.nullif(F.trim(x), F.lit("")), F.concat(F.lit("_c"), i.cast("string"))))
    return F.transform(named, lambda x, i: F.when(F.size(F.filter(named, lambda y: y == x)) > 1, F.concat(x, i.cast("string"))).otherwise(x))


def csv_union_with_path(spark: SparkSession, root: str, file_name: str) -> DataFrame:
    """Every ``file_name`` CSV below ``root``; ``model_path`` = the file's folder. Files with other headers
    are unioned by name (missing columns NULL); all columns are text. Empty files give no rows, no file at all is an error.

    One scan whatever the number of files: rows are read by place, the headers are a table of one row per file, and each row's values
    take the names of its file's header. The driver gets the distinct names and the number of files.
    """
    path = F.col("_metadata.file_path")
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", file_name).text(root)
    lines = lines.where(F.col("_metadata.file_block_start") == 0).withColumn("at", F.monotonically_increasing_id())
    heads = cut_lineage(lines.groupBy(path.alias("path")).agg(F.min_by("value", "at").alias("head")))
    files, width = heads.agg(F.count(F.lit(1)), F.max(F.size(F.split("head", ",")))).first()
    if not files:
        raise FileNotFoundError(f"no {file_name} under {root}")
    heads = heads.select("path", _header_names(F.col("head"), width).alias("names"))
    names = heads.select("path", F.posexplode("names").alias("at", "name")).groupBy("name").agg(F.min(F.struct("path", "at")).alias("first"))
    columns = [r["name"] for r in names.orderBy("first").collect()]  # the columns of the result
    rows = spark.read.schema(", ".join(f"c{i} string" for i in range(width))).option("header", True).option(
        "recursiveFileLookup", True).option("pathGlobFilter", file_name).csv(root)
    rows = rows.select(path.alias("path"), F.array(*[f"c{i}" for i in range(width)]).alias("v"))
    rows = rows.join(F.broadcast(heads) if files <= MAX_BROADCAST_FILES else heads, "path")
    rows = rows.withColumn("m", F.map_from_arrays("names", F.slice("v", F.lit(1), F.size("names"))))
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    return rows.select(folder.alias("model_path"), *[F.col("m")[F.lit(c)].alias(c) for c in columns])


def read_json_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of every ``*.json`` file below ``root`` (whole file per row)."""
    d = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root)
    return d.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def resolve_version(spark: SparkSession, data_dir: str, wanted: int) -> tuple[str, int | None]:
    """(directory to load, rows to sample or None). Exact size folder if present; else the largest
    numeric folder when it is bigger than ``wanted`` (then sample ``wanted`` rows); else an error.

    ``data_dir`` is any path or URI that the session reads. Spark lists the files, and the driver gets the distinct
    numeric folder names; a folder without files does not count.
    """
    root = data_dir.rstrip("/")
    below = posixpath.normpath(re.sub(r"^[A-Za-z][\w+.-]*:(//[^/]*)?", "", root)).strip("/")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    try:
        files = listed.load(root).select("path")
    except AnalysisException as e:
        raise ValueError(f"Data path {root}/{wanted} does not exist.") from e
    name = F.regexp_extract("path", f"/\\Q{below}\\E/([0-9]+)/", 1)
    found = [r[0] for r in files.select(name.alias("n")).where("n <> ''").distinct().collect()]
    if str(wanted) in found:
        return f"{root}/{wanted}", None
    biggest = max(found, key=int, default="0")
    if wanted < int(biggest):
        return f"{root}/{biggest}", wanted
    raise ValueError(f"Data path {root}/{wanted} does not exist.")


def read_task_lists(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark task lists ``{language: {stage: [task, ...]}}`` (a small YAML config) → (language, stage, task)."""
    import yaml

    with open(path, encoding="utf-8") as f:
        cfg = yaml.safe_load(f) or {}
    rows = [(lang, stage, str(task)) for lang, stages in cfg.items() for stage, tasks in (stages or {}).items()
            for task in (tasks or [])]
    return spark.createDataFrame(rows, "language string, stage string, task string")


# ---------------- sinks ----------------

def write_dataset(df: DataFrame, path: str, partition: Sequence[str] = ("subset",), mode: str = "overwrite") -> None:
    """Columnar dataset folder, partitioned by subset (later reads prune subsets)."""
    df.write.mode(mode).partitionBy(*partition).parquet(path)


def write_embeddings(emb: DataFrame, path: str, mode: str = "overwrite", rows_per_file: int = 1_000_000) -> None:
    """(emb_idx, embedding) range-partitioned and sorted by ``emb_idx`` so index ranges map to files."""
    n = max(1, -(-emb.count() // rows_per_file))
    emb.repartitionByRange(n, "emb_idx").sortWithinPartitions("emb_idx").write.mode(mode).parquet(path)


def write_vector_store(emb: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """(emb_idx, embedding) as a table in ``buckets`` files by hash of ``emb_idx``, sorted in each. A lookup join on ``emb_idx``
    reads it in place: only the asking rows move. Take about 256 MB a bucket; returns the table."""
    spark = emb.sparkSession
    dealt = emb.select("emb_idx", "embedding").repartition(buckets, "emb_idx")  # one file a bucket
    dealt.write.bucketBy(buckets, "emb_idx").sortBy("emb_idx").option("path", path).mode("overwrite").saveAsTable(table)
    return spark.table(table)


def write_summary_json(df: DataFrame, path: str) -> None:
    """Small side tables (summaries, plans, stats) as one JSON document per row."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSONL records (triplets, text+label)."""
    df.write.mode(mode).json(path)


def dir_name_of(path: str) -> str:
    return re.sub(r"/+$", "", path).rsplit("/", 1)[-1]
