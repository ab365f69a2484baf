"""Registered score-aggregation queries (G12–G14, P24–P28) and SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scores as SC
from .fixtures import CFG_SQL, SCORES_SQL, TASK_SQL, TASK_SUFFIXES, Tables, run_configs, score_rows, task_tables
from .registry import register

DROP = ["ErrorSummarization"]


def _rules_sql(x: str) -> str:
    parts = []
    for subs, cat in SC.NAME_RULES:
        cond = " OR ".join(f"strpos(lower({x}), '{s}') > 0" for s in subs)
        parts.append(f"WHEN {cond} THEN '{cat}'")
    return "CASE " + " ".join(parts) + " ELSE 'Other' END"


CAT_SQL = f"""cats AS (SELECT t.task, coalesce(o.category, m.category, {_rules_sql('t.task')}) AS category
                FROM tasks t LEFT JOIN overrides o USING (task) LEFT JOIN metadata m USING (task))"""
AVG_SQL = f"""{SCORES_SQL},
{CAT_SQL},
s AS (SELECT sc.*, cats.category FROM sc JOIN cats USING (task) WHERE task NOT IN ({", ".join(f"'{d}'" for d in DROP)})),
pc AS (SELECT run_name, code_name, category, avg(score) AS value FROM s GROUP BY ALL),
av AS (SELECT run_name, code_name, 'avg_' || category AS name, round(value, 6) AS value FROM pc
       UNION ALL SELECT run_name, code_name, 'micro_ave', round(avg(score), 6) FROM s GROUP BY ALL
       UNION ALL SELECT run_name, code_name, 'macro_ave', round(avg(value), 6) FROM pc GROUP BY ALL)"""


def _cats(t: Tables):
    tasks, overrides, metadata = task_tables(t)
    return SC.task_category(tasks, overrides, metadata)


def _scores(t: Tables):
    return SC.restrict_scores(score_rows(t), drop=DROP)


@register("run_code_name", f"WITH {CFG_SQL} SELECT run_name, code_name FROM cn")
def q_run_code_name(t: Tables):
    cfg = run_configs(t)
    return cfg.select("run_name", SC.run_code_name(cfg).alias("code_name"))


@register("task_category", f"WITH {SCORES_SQL}, {CAT_SQL} SELECT task, category FROM cats")
def q_task_category(t: Tables):
    return _cats(t).select("task", "category")


@register("score_averages", f"WITH {AVG_SQL} SELECT * FROM av")
def q_score_averages(t: Tables):
    return SC.score_averages(_scores(t), _cats(t))


# fixed list: the event types that name tasks (the oracle needs every column by name)
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
TABLE_TASKS = [x for e in EVENT_TYPES for s in TASK_SUFFIXES if (x := e.capitalize() + s) not in DROP]
TABLE_AVGS = ["macro_ave", "micro_ave", *(f"avg_{c}" for c in SC.CATEGORY_ORDER)]


def _columns_sql(key: str, value: str, names: list[str]) -> str:
    return ", ".join(f"max({value}) FILTER (WHERE {key} = '{n}') AS \"{n}\"" for n in names)


@register("score_table", f"""WITH {AVG_SQL},
wa AS (SELECT code_name, run_name, {_columns_sql("name", "value", TABLE_AVGS)} FROM av GROUP BY code_name, run_name),
wt AS (SELECT code_name, run_name, {_columns_sql("task", "score", TABLE_TASKS)} FROM s GROUP BY code_name, run_name)
SELECT * FROM wa JOIN wt USING (code_name, run_name)""")
def q_score_table(t: Tables):
    return SC.score_table(_scores(t), _cats(t).filter(~F.col("task").isin(*DROP)))


def score_files(t: Tables):
    """(path, content): score JSON files of every run in the layouts the score reader accepts."""
    e = t.events.groupBy("user_id", "event_type").agg(F.avg("value").alias("x"))
    cap = F.concat(F.upper(F.substring("event_type", 1, 1)), F.substring("event_type", 2, 100))
    base = F.concat(F.lit("runs/run"), F.col("user_id").cast("string"), F.lit("/"))
    et = F.col("event_type")
    res_path = F.concat(base, cap, F.lit("/results.json"))
    flat_path = F.concat(base, cap, F.lit(".json"))
    x = F.col("x")
    sc = lambda split, v: F.struct(F.lit(split).alias("split"), v.alias("main_score"))
    rows = e.select(
        F.when(et.isin("click", "view"), res_path).otherwise(flat_path).alias("path"),
        F.when(et == "click", F.to_json(F.struct(F.array(sc("dev", x + 1), sc("test", x)).alias("scores"))))
        .when(et == "view", F.to_json(F.struct(F.array(sc("dev", x)).alias("scores"))))
        .when(et == "error", F.to_json(F.struct(F.struct(x.alias("main_score")).alias("test"))))
        .when(et == "purchase", F.to_json(F.struct(x.alias("main_score"))))
        .otherwise(F.to_json(F.struct(F.concat(F.lit("Named"), cap).alias("task_name"), x.alias("main_score")))).alias("content"))
    dup = e.filter(et == "click").select(flat_path.alias("path"), F.to_json(F.struct((x + 100).alias("main_score"))).alias("content"))
    meta = e.filter(et == "view").select(F.concat(base, F.lit("model_meta.json")).alias("path"),
                                         F.to_json(F.struct(x.alias("main_score"))).alias("content"))
    bad = e.filter(et == "signup").select(F.concat(base, F.lit("broken.json")).alias("path"), F.lit("{not json").alias("content"))
    return rows.unionByName(dup).unionByName(meta.distinct()).unionByName(bad.distinct())


FILES_SQL = """e AS (SELECT user_id, event_type, avg(value) AS x FROM events GROUP BY ALL),
f AS (SELECT 'runs/run' || user_id || '/' || upper(substr(event_type, 1, 1)) || substr(event_type, 2) AS b, * FROM e),
files AS (
  SELECT CASE WHEN event_type IN ('click', 'view') THEN b || '/results.json' ELSE b || '.json' END AS path,
         CASE event_type WHEN 'click' THEN x WHEN 'view' THEN x ELSE x END AS score,
         CASE WHEN event_type = 'signup' THEN 'Named' || upper(substr(event_type, 1, 1)) || substr(event_type, 2) END AS task_name,
         CASE WHEN event_type IN ('click', 'view') THEN 0 ELSE 1 END AS prio
  FROM f
  UNION ALL SELECT b || '.json', x + 100, NULL, 1 FROM f WHERE event_type = 'click')"""


@register("main_scores", f"""WITH {FILES_SQL},
t AS (SELECT regexp_extract(path, 'runs/([^/]+)/', 1) AS run,
             coalesce(task_name, CASE WHEN prio = 0 THEN string_split(path, '/')[-2] ELSE regexp_replace(string_split(path, '/')[-1], '\\.json$', '') END) AS task,
             score, prio, path FROM files)
SELECT run, task, arg_min(score, (prio, path)) AS score FROM t GROUP BY run, task""")
def q_main_scores(t: Tables):
    files = score_files(t)
    return SC.main_scores(files, F.regexp_extract("path", r"runs/([^/]+)/", 1))


@register("score_cleanup", f"""WITH {CFG_SQL},
raw AS (SELECT CASE WHEN user_id % 2 = 0 THEN '[run' || user_id || '](http://x/' || user_id || ')' ELSE 'run' || user_id END AS Model,
               {TASK_SQL} AS task,
               CASE WHEN event_type = 'error' THEN 'n/a' ELSE CAST(CAST(floor(avg(value)) AS BIGINT) AS VARCHAR) END AS score
        FROM events GROUP BY user_id, event_type, task)
SELECT coalesce(regexp_extract(Model, '^\\[([^\\]]+)\\]\\([^\\)]+\\)$', 1), '') AS name_part,
       CASE WHEN regexp_extract(Model, '^\\[([^\\]]+)\\]\\([^\\)]+\\)$', 1) <> '' THEN regexp_extract(Model, '^\\[([^\\]]+)\\]\\([^\\)]+\\)$', 1) ELSE Model END AS code_name,
       task, TRY_CAST(score AS DOUBLE) AS score FROM raw""")
def q_score_cleanup(t: Tables):
    from .fixtures import _task_col
    e = t.events
    model = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("[run"), F.col("user_id").cast("string"), F.lit("](http://x/"),
                                                    F.col("user_id").cast("string"), F.lit(")"))).otherwise(
        F.concat(F.lit("run"), F.col("user_id").cast("string")))
    raw = e.groupBy("user_id", "event_type", _task_col().alias("task")).agg(F.avg("value").alias("_v"))
    raw = raw.select(model.alias("Model"), "task", F.when(F.col("event_type") == "error", F.lit("n/a"))
                     .otherwise(F.floor("_v").cast("bigint").cast("string")).alias("score"))
    out = SC.score_cleanup(raw)
    return out.select(F.regexp_extract("Model", r"^\[([^\]]+)\]\([^\)]+\)$", 1).alias("name_part"), "code_name", "task", "score")


@register("rewrite_value", f"""WITH {CFG_SQL}
SELECT run_name, data_name AS old,
       CASE WHEN loss_type = 'kld' AND data_name <> 'click' THEN 'click' ELSE data_name END AS new,
       CASE WHEN loss_type <> 'kld' THEN 'keep' WHEN data_name = 'click' THEN 'skip' ELSE 'update' END AS action
FROM cfg""")
def q_rewrite_value(t: Tables):
    cfg = run_configs(t)
    return SC.rewrite_value(cfg, F.col("loss_type") == "kld", "data_name", "click").select("run_name", "old", "new", "action")


def task_catalog(t: Tables):
    tasks, _, _ = task_tables(t)
    ev = tasks.select(F.lit("eng").alias("language"), F.lit("on_eval_tasks").alias("stage"), "task")
    tr = tasks.filter(F.col("task").contains("STS") | F.col("task").contains("Retrieval")).select(
        F.lit("eng").alias("language"), F.lit("on_train_tasks").alias("stage"), "task")
    jp = tasks.filter(F.col("task").startswith("Purchase")).select(F.lit("jpn").alias("language"), F.lit("on_eval_tasks").alias("stage"), "task")
    return ev.unionByName(tr).unionByName(jp)


@register("select_tasks", f"""WITH {SCORES_SQL}
SELECT DISTINCT task FROM tasks WHERE (strpos(task, 'STS') > 0 OR strpos(task, 'Retrieval') > 0) AND task <> 'ClickSTS'""")
def q_select_tasks(t: Tables):
    return SC.select_tasks(task_catalog(t), "eng", "on_train_tasks", drop=["ClickSTS"])
