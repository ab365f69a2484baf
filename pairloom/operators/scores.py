"""Benchmark score tables (G12–G14, P24–P28): long score rows, categories, averages, the wide table.

Scores stay long (run_name, code_name, task, score) until the final pivot, whose column list is the
task list (one entry per task, so bounded by the benchmark size).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: category order and the name rules used when no override or metadata applies ----
CATEGORY_ORDER = ["Retrieval", "Reranking", "Classification", "PairClassification", "STS", "Clustering",
                  "Summarization", "Other"]
RETRIEVAL_ALIASES = ["arguana", "askubuntudupquestions", "fiqa2018", "scidocs", "treccovid", "twitterurlcorpus",
                     "hotpotqahardnegatives", "feverhardnegatives", "climatefeverhardnegatives", "touche2020"]
NAME_RULES = [  # (substrings of the lower-cased name, category), first match wins
    (["reranking"], "Reranking"),
    (["retrieval"], "Retrieval"),
    (["clustering"], "Clustering"),
    (["classification"], "Classification"),
    (["summarization", "summeval"], "Summarization"),
    (["sts", "sick", "biosses"], "STS"),
    (RETRIEVAL_ALIASES, "Retrieval"),
    (["duplicate", "quora"], "PairClassification"),
]
# ---- end of fixed values ----


def run_code_name(cfg: DataFrame) -> Column:
    """``{data}_e{epochs}_bs{global batch}_{scheduler}{lr}_{loss}{weight}{_w-pos}{_prefix}{_lora}``.

    global batch = ``global_batch_size`` when set, else ``batch_size · world_size``; the weight is
    shown only when it differs from 1.0; boolean tags appear when true.
    """
    cols = set(cfg.columns)

    def opt(name: str, default):
        return F.col(name) if name in cols else F.lit(default)

    gbs = F.coalesce(opt("global_batch_size", None).cast("bigint"), (F.col("batch_size") * opt("world_size", 1)).cast("bigint"))
    data = F.col("data_name") if "data_name" in cols else F.col("dataset_name")
    w = opt("distill_weight", 1.0).cast("double")
    weight = F.when(w != 1.0, w.cast("string")).otherwise(F.lit(""))
    tag = lambda c, s: F.when(F.coalesce(opt(c, False).cast("boolean"), F.lit(False)), F.lit(s)).otherwise(F.lit(""))
    return F.concat(data, F.lit("_e"), F.col("num_epochs").cast("string"), F.lit("_bs"), gbs.cast("string"), F.lit("_"),
                    F.col("scheduler"), F.col("lr").cast("string"), F.lit("_"), F.col("loss_type"), weight,
                    tag("use_pos", "_w-pos"), tag("add_prefix", "_prefix"), tag("use_lora", "_lora"))


def score_cleanup(df: DataFrame, model: str = "Model", score: str = "score") -> DataFrame:
    """P25: ``[Name](url)`` → ``Name``; score strings → DOUBLE, unparsable → NULL."""
    name = F.regexp_extract(F.col(model), r"^\[([^\]]+)\]\([^\)]+\)$", 1)
    return (df.withColumn("code_name", F.when(name != "", name).otherwise(F.col(model)))
            .withColumn(score, F.expr(f"try_cast({score} AS DOUBLE)")))


def name_category(task: Column) -> Column:
    n = F.lower(task)
    out = F.lit("Other")
    for subs, cat in reversed(NAME_RULES):
        cond = F.lit(False)
        for s in subs:
            cond = cond | (F.instr(n, s) > 0)
        out = F.when(cond, F.lit(cat)).otherwise(out)
    return out


def task_category(tasks: DataFrame, overrides: DataFrame | None = None, metadata: DataFrame | None = None,
                  task: str = "task") -> DataFrame:
    """category = override > benchmark metadata > name rules > ``Other``.

    ``overrides`` / ``metadata`` are (task, category) tables with one row per task (broadcast).
    """
    d = tasks
    parts = []
    for i, m in enumerate([overrides, metadata]):
        if m is not None:
            d = d.join(F.broadcast(m.select(F.col("task").alias(task), F.col("category").alias(f"_c{i}"))), task, "left")
            parts.append(F.col(f"_c{i}"))
    d = d.withColumn("category", F.coalesce(*parts, name_category(F.col(task))))
    return d.drop(*[f"_c{i}" for i in range(2)])


def select_tasks(tasks: DataFrame, language: str, stage: str, only: Sequence[str] = (), drop: Sequence[str] = (),
                 benchmark: DataFrame | None = None) -> DataFrame:
    """tasks(language, stage, task) → tasks of one language and stage; ``only`` restricts to exact
    names (none matching is an error), ``drop`` removes names, ``benchmark`` (task) keeps its members."""
    d = tasks.filter((F.col("language") == language) & (F.col("stage") == stage)).select("task").distinct()
    if only:
        d = d.filter(F.col("task").isin(*only))
        if d.isEmpty():
            raise ValueError(f"no tasks matched only={sorted(only)}")
    if drop:
        d = d.filter(~F.col("task").isin(*drop))
    if benchmark is not None:
        d = d.join(benchmark.select("task").distinct(), "task", "left_semi")
    return d


def restrict_scores(scores: DataFrame, benchmark: DataFrame | None = None, drop: Sequence[str] = ()) -> DataFrame:
    d = scores
    if benchmark is not None and not benchmark.isEmpty():
        d = d.join(F.broadcast(benchmark.select("task").distinct()), "task", "left_semi")
    if drop:
        d = d.filter(~F.col("task").isin(*drop))
    return d


def score_averages(scores: DataFrame, categories: DataFrame) -> DataFrame:
    """Per run: ``avg_<category>`` (NULL-skipping mean over the category's tasks), ``micro_ave`` (mean
    over tasks), ``macro_ave`` (mean over the category averages). Long output (run_name, code_name, name, value).

    One aggregation over the scores gives per-(run, category) sum, count and mean; micro and macro are
    derived from that small table.
    """
    s = scores.join(F.broadcast(categories.select("task", "category")), "task")
    per_cat = s.groupBy("run_name", "code_name", "category").agg(
        F.sum("score").alias("_s"), F.count("score").alias("_c"), F.avg("score").alias("value"))
    cat_rows = per_cat.select("run_name", "code_name", F.concat(F.lit("avg_"), F.col("category")).alias("name"), "value")
    tot = per_cat.groupBy("run_name", "code_name").agg(
        F.try_divide(F.sum("_s"), F.sum("_c")).alias("micro_ave"), F.avg("value").alias("macro_ave"))
    both = tot.select("run_name", "code_name", F.explode(F.array(
        F.struct(F.lit("micro_ave").alias("name"), F.col("micro_ave").alias("value")),
        F.struct(F.lit("macro_ave").alias("name"), F.col("macro_ave").alias("value")))).alias("_x"))
    out = cat_rows.unionByName(both.select("run_name", "code_name", "_x.name", "_x.value"))
    return out.select("run_name", "code_name", "name", F.round("value", 6).alias("value"))


def ordered_task_columns(categories: DataFrame, category_order: Sequence[str] = CATEGORY_ORDER) -> tuple[list[str], list[str]]:
    """(task columns by category order then name, category average columns in order). One row per task."""
    rows = categories.select("task", "category").distinct().collect()
    rank = {c: i for i, c in enumerate(category_order)}
    known = sorted((r for r in rows if r["category"] in rank), key=lambda r: (rank[r["category"]], r["task"]))
    unknown = sorted(r["task"] for r in rows if r["category"] not in rank)
    cats = [c for c in category_order if any(r["category"] == c for r in rows)]
    return [r["task"] for r in known] + unknown, [f"avg_{c}" for c in cats]


def score_table(scores: DataFrame, categories: DataFrame) -> DataFrame:
    """Wide table sorted by (code_name, run_name); columns: meta → macro/micro → category averages → tasks."""
    tasks, avg_cols = ordered_task_columns(categories)
    wide_tasks = scores.groupBy("code_name", "run_name").pivot("task", tasks).agg(F.first("score"))
    av = score_averages(scores, categories)
    wide_avg = av.groupBy("code_name", "run_name").pivot("name", ["macro_ave", "micro_ave"] + avg_cols).agg(F.first("value"))
    j = wide_avg.join(wide_tasks, ["code_name", "run_name"], "left")
    return j.select("code_name", "run_name", "macro_ave", "micro_ave", *avg_cols, *[F.col(f"`{t}`") for t in tasks]).orderBy(
        "code_name", "run_name")


SCORE_JSON_SCHEMA = ("struct<task_name: string, scores: array<struct<split: string, main_score: double>>, "
                     "test: struct<main_score: double>, main_score: double>")


def main_score(content: Column) -> Column:
    """``scores[split=test]`` → first ``scores[]`` with a score → ``test.main_score`` → ``main_score``."""
    j = F.from_json(content, SCORE_JSON_SCHEMA)
    with_score = F.filter(j["scores"], lambda x: x["main_score"].isNotNull())
    test = F.filter(with_score, lambda x: x["split"] == "test")
    return F.coalesce(F.try_element_at(test, F.lit(1))["main_score"], F.try_element_at(with_score, F.lit(1))["main_score"],
                      j["test"]["main_score"], j["main_score"])


def main_scores(files: DataFrame, run: Column, path: str = "path", content: str = "content") -> DataFrame:
    """G14 + S10: (path, content) JSON files → (run, task, score). ``*results.json`` files win over other files
    (task = ``task_name`` or the parent folder); other files use ``task_name`` or the file stem; within a
    priority the smallest path wins. ``model_meta.json`` and unreadable files are skipped."""
    p = F.col(path)
    fname = F.element_at(F.split(p, "/"), -1)
    parent = F.element_at(F.split(p, "/"), -2)
    is_res = fname.endswith("results.json")
    j = F.from_json(F.col(content), SCORE_JSON_SCHEMA)
    task = F.coalesce(j["task_name"], F.when(is_res, parent).otherwise(F.regexp_replace(fname, r"\.json$", "")))
    d = files.filter(fname.endswith(".json") & (fname != "model_meta.json")).select(
        run.alias("run"), task.alias("task"), main_score(F.col(content)).alias("score"),
        F.when(is_res, 0).otherwise(1).alias("_prio"), p.alias("_path"))
    d = d.filter(F.col("task").isNotNull() & F.col("score").isNotNull())
    best = d.groupBy("run", "task").agg(F.min(F.struct("_prio", "_path", "score")).alias("_b"))
    return best.select("run", "task", F.col("_b.score").alias("score"))


def merge_fresh(cached: DataFrame, fresh: DataFrame, keys: Sequence[str] = ("run", "task")) -> DataFrame:
    """Fresh scores override cached ones for the same keys."""
    return fresh.unionByName(cached.join(fresh.select(*keys), list(keys), "left_anti"))


def rewrite_value(cfg: DataFrame, match: Column, column: str, new_value: str) -> DataFrame:
    """Rows matching ``match`` get ``column = new_value``; rows already equal are skipped.

    Returns every row with ``old``, ``new`` and ``action`` in {update, skip, keep}; a dry run just reads it.
    """
    old = F.col(column)
    action = F.when(~match, "keep").when(old == F.lit(new_value), "skip").otherwise("update")
    return cfg.select("*", old.alias("old"), action.alias("action")).withColumn(
        "new", F.when(F.col("action") == "update", F.lit(new_value)).otherwise(F.col("old"))).withColumn(
        column, F.col("new"))
