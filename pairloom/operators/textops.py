"""Text-level table operators: title/body joins, instructions, prefixes, line chunking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import h, spark_sql_h
from ..functions.text import py_strip
from .indexing import mark_first
from .ordering import one_limit

# fixed values: per-subset (query prefix, document prefix); other subsets use the defaults
DEFAULT_PREFIX = ("query:", "document:")
PREFIX_MAP = {
    "HotpotQA": ("query:", "document:"),
    "NQ": ("query:", "document:"),
    "SQuAD": ("query:", "document:"),
    "Trivia": ("query:", "document:"),
    "en_NLI_data": ("query:", "query:"),
    "fever": ("query:", "document:"),
    "ms-marco": ("query:", "document:"),
    "S2ORC_title_abstract": ("query:", "document:"),
    "SimpleWiki": ("query:", "document:"),
    "agnews": ("query:", "document:"),
    "amazon-qa": ("query:", "document:"),
    "amazon_review_2018": ("query:", "document:"),
    "ccnews_title_text": ("query:", "document:"),
    "cnn_dailymail": ("query:", "document:"),
    "coco_captions": ("query:", "query:"),
    "codesearchnet": ("query:", "query:"),
    "eli5_question_answer": ("query:", "document:"),
    "gooaq_pairs": ("query:", "document:"),
    "npr": ("query:", "document:"),
    "searchQA_top5_snippets": ("query:", "query:"),
    "sentence-compression": ("query:", "query:"),
    "stackexchange_duplicate_questions_body_body": ("query:", "query:"),
    "stackexchange_duplicate_questions_title-body_title-body": ("query:", "query:"),
    "stackexchange_duplicate_questions_title_title": ("query:", "query:"),
    "wikihow": ("query:", "document:"),
    "xsum": ("query:", "document:"),
    "yahoo_answers_title_answer": ("query:", "document:"),
}


def title_text(title: Column, text: Column, mode: str = "raw") -> Column:
    """``title + ' ' + text``; mode ``raw`` (no strip), ``strip`` (strip result) or ``strip_both``."""
    if mode == "raw":
        return F.concat(title, F.lit(" "), text)
    if mode == "strip":
        return py_strip(F.concat(title, F.lit(" "), text))
    return F.concat(py_strip(title), F.lit(" "), py_strip(text))


def compose_text(title: Column, content: Column, joiner: str = "\n\n") -> Column:
    """``title + joiner + content`` when content is non-empty, else the title."""
    return F.when(F.coalesce(F.length(content), F.lit(0)) > 0, F.concat(title, F.lit(joiner), content)).otherwise(title)


def strip_after_query(t: Column) -> Column:
    """P9 (training collator): text after the first ``Query:``, stripped; unchanged when absent."""
    return F.when(F.instr(t, "Query:") > 0, py_strip(F.element_at(F.split(t, "Query:", 2), 2))).otherwise(t)


def normalize_query(t: Column) -> Column:
    """P9 (negative lookup): for ``Instruct:`` texts the part between the first and second ``Query:``."""
    parts = F.split(t, "Query:")
    inner = F.when(F.size(parts) > 1, py_strip(F.element_at(parts, 2))).otherwise(py_strip(t))
    return F.when(t.startswith("Instruct:"), inner).otherwise(py_strip(t))


def subset_prefix(df: DataFrame, subset: str = "subset", anc: str = "anc", pos: str = "pos") -> DataFrame:
    """P10: ``'{query prefix} ' + anc`` and ``'{document prefix} ' + pos`` per subset (27-entry map)."""
    m = F.create_map(*[x for k, (q, d) in PREFIX_MAP.items() for x in (F.lit(k), F.array(F.lit(q), F.lit(d)))])
    pre = F.coalesce(F.element_at(m, F.col(subset)), F.array(F.lit(DEFAULT_PREFIX[0]), F.lit(DEFAULT_PREFIX[1])))
    return df.withColumn(anc, F.concat_ws(" ", pre[0], F.col(anc))).withColumn(pos, F.concat_ws(" ", pre[1], F.col(pos)))


def chunk_lines(df: DataFrame, key: str, text: str = "text", ratio: float = 0.3, seed: int = 42,
                max_lines: int = 10, min_chars: int = 20) -> DataFrame:
    """``floor(n·ratio)`` texts (first by hash) are cut into chunks of 3..max_lines lines.

    Chunk sizes are hash draws ``3 + h % (min(max_lines, n-i) - 2)`` while ``i + 2 < n``; a chunk under
    ``min_chars`` merges into the previous kept chunk (a short first chunk is kept). Other texts pass
    through. Output: (key, part, text); ``part`` = -1 for untouched texts.
    """
    total = df.count()
    n_short = int(total * ratio)
    marked = mark_first(df.select(key, text), one_limit(df, n_short), h(seed, "short", F.col(key)), [key], out="_first")
    chosen = marked.filter("_first")
    keep = marked.filter(~F.col("_first")).select(key, F.lit(-1).cast("bigint").alias("part"), F.col(text).alias("text"))
    lines = F.split(F.col(text), "\n")
    c = chosen.select(key, lines.alias("_l"), F.size(lines).alias("_n"))
    hk = spark_sql_h(seed, f"`{key}`", "acc.k", "'chunk'")
    fold = (f"aggregate(sequence(1, greatest(_n, 1)), named_struct('i', 0, 'k', 0, 's', cast(array() as array<struct<i:int,z:int>>)), "
            f"(acc, x) -> CASE WHEN acc.i + 2 < _n THEN named_struct('i', acc.i + CAST(3 + {hk} % (least({max_lines}, _n - acc.i) - 2) AS INT), "
            f"'k', acc.k + 1, 's', concat(acc.s, array(named_struct('i', acc.i, 'z', CAST(3 + {hk} % (least({max_lines}, _n - acc.i) - 2) AS INT))))) "
            f"ELSE acc END, acc -> acc.s)")
    c = c.withColumn("_s", F.expr(fold))
    ex = c.select(key, "_l", F.posexplode("_s").alias("_k", "_c"))
    ex = ex.select(key, "_k", F.array_join(F.slice("_l", F.col("_c.i") + 1, F.col("_c.z")), "\n").alias("_t"))
    starts = ((F.col("_k") == 0) | (F.length("_t") >= min_chars)).cast("int")
    w = Window.partitionBy(key).orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    ex = ex.withColumn("_g", F.sum(starts).over(w) - 1)
    merged = ex.groupBy(key, "_g").agg(F.array_sort(F.collect_list(F.struct("_k", "_t"))).alias("_p"))
    merged = merged.select(key, F.col("_g").cast("bigint").alias("part"),
                           F.array_join(F.transform("_p", lambda p: p["_t"]), "\n").alias("text"))
    return keep.unionByName(merged)


MAX_PROMPTS = 10_000


def prompt_variants(df: DataFrame, prompts: dict[str, str], text: str = "text") -> DataFrame:
    """Every text once per prompt of a prompt map (name → prefix): rows (…, prompt_name, prompted).

    The map is configuration (a handful of prompts, size-checked); it is inlined as a literal array and
    exploded per row, so no join is planned.
    """
    if len(prompts) > MAX_PROMPTS:
        raise ValueError("prompt map too large to inline")
    arr = F.array(*[F.struct(F.lit(k).alias("prompt_name"), F.lit(v).alias("prompt")) for k, v in sorted(prompts.items())])
    x = df.select("*", F.explode(arr).alias("_p"))
    return x.select(*df.columns, F.col("_p.prompt_name").alias("prompt_name"),
                    F.concat(F.col("_p.prompt"), F.col(text)).alias("prompted"))

