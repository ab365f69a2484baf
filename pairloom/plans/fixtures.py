"""Derivations of the reference's input shapes from the driver tables (FIXTURES.md part 2).

Each fixture has a Spark builder and the matching SQL CTE used by the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import first_line, rest_lines
from ..operators.indexing import range_row_index
from . import sqltext as S

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


class Tables:
    """Lazy parquet tables of one scale-factor folder; derived fixtures are built once per instance."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        self._memo: dict = {}

    def memo(self, key, build, persist: bool = True):
        """Build a derived table once per instance. Derived tables are read by several branches and by the
        planning jobs of the operators above them (counts, boundary samples), so they are persisted
        (memory and disk; a lost block is recomputed from lineage)."""
        if key not in self._memo:
            out = build()
            if persist:
                out = tuple(x.persist() for x in out) if isinstance(out, tuple) else out.persist()
            self._memo[key] = out
        return self._memo[key]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLES:
            raise AttributeError(name)
        return self.memo(("table", name), lambda: self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet"), persist=False)


# ---------- PAIR: documents → first line / remaining lines ----------

def pairs(t: Tables) -> DataFrame:
    return t.memo("pairs", lambda: _pairs(t))


def _pairs(t: Tables) -> DataFrame:
    """PAIR (anc, pos, subset, id, label, doc_id): id = position inside the subset by doc_id."""
    d = t.documents.select("doc_id", "source", "lang", first_line(F.col("text")).alias("anc"),
                           rest_lines(F.col("text")).alias("pos"))
    d = d.filter(F.col("pos").isNotNull() & (F.length("anc") > 0) & (F.length("pos") > 0))
    d = range_row_index(d, [("doc_id", True)], out="id", group=["source"])
    return d.select("anc", "pos", F.col("source").alias("subset"), "id", F.col("lang").alias("label"), "doc_id")


PAIR_SQL = f"""pair AS (
  SELECT {S.first_line('text')} AS anc, {S.rest_lines('text')} AS pos, source AS subset,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS id, lang AS label, doc_id
  FROM documents
  WHERE strpos(text, chr(10)) > 0 AND length({S.first_line('text')}) > 0 AND length({S.rest_lines('text')}) > 0)"""


# ---------- instruction map: one row per subset, derived from the sources ----------

def instructions(t: Tables) -> DataFrame:
    return t.memo("instructions", lambda: _instructions(t))


def _instructions(t: Tables) -> DataFrame:
    """Sources sorting before ``src5`` get an instruction; the others have none (empty by default)."""
    s = t.documents.select(F.col("source").alias("subset")).distinct().filter(F.col("subset") < "src5")
    return s.select("subset", F.concat(F.lit("Retrieve a passage that continues this "), F.col("subset"),
                                       F.lit(" text")).alias("instruction"))


INSTR_SQL = """instr AS (
  SELECT DISTINCT source AS subset, 'Retrieve a passage that continues this ' || source || ' text' AS instruction
  FROM documents WHERE source < 'src5')"""


# ---------- conversations: query = first user turn, assistant turns in order ----------

def conv_qa(t: Tables) -> DataFrame:
    return t.memo("conv_qa", lambda: _conv_qa(t))


def _conv_qa(t: Tables) -> DataFrame:
    """(conv_id, query, answers[]) ; query = first user text, answers = assistant texts by turn."""
    c = t.conversations
    g = c.groupBy("conv_id").agg(
        F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("query"),
        F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", "text")))).alias("_a"),
    )
    return g.select("conv_id", "query", F.transform("_a", lambda x: x["text"]).alias("answers")).filter(F.col("query").isNotNull())


CONV_SQL = """conv AS (
  SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS query,
         coalesce(list(text ORDER BY turn) FILTER (WHERE role = 'assistant'), CAST([] AS VARCHAR[])) AS answers
  FROM conversations GROUP BY conv_id HAVING count(*) FILTER (WHERE role = 'user') > 0)"""


def jsonl_lines(t: Tables) -> DataFrame:
    return t.memo("jsonl_lines", lambda: _jsonl_lines(t))


def _jsonl_lines(t: Tables) -> DataFrame:
    """Raw JSONL "files" (file, line_no, value) in the four shapes, built from the tables."""
    p = pairs(t)
    nxt = p.select("subset", (F.col("id") - 1).alias("id"), F.col("anc").alias("_n"))
    lp = p.select(F.lit("list_pairs").alias("file"), F.col("doc_id").alias("line_no"),
                  F.to_json(F.array("anc", "pos")).alias("value"))
    lt = p.join(nxt, ["subset", "id"], "left").select(
        F.lit("list_triples").alias("file"), F.col("doc_id").alias("line_no"),
        F.to_json(F.when(F.col("_n").isNull(), F.array("anc", "pos")).otherwise(F.array("anc", "pos", "_n"))).alias("value"))
    st = t.documents.select(F.lit("sets").alias("file"), F.col("doc_id").alias("line_no"),
                            F.to_json(F.struct(F.split("text", "\n").alias("set"))).alias("value"))
    qa = conv_qa(t)
    nq = qa.select((F.col("conv_id") - 1).alias("conv_id"), F.col("answers").alias("_neg"))
    qp = qa.select(F.lit("qpos").alias("file"), F.col("conv_id").alias("line_no"),
                   F.to_json(F.struct("query", F.col("answers").alias("pos"))).alias("value"))
    qpn = qa.join(nq, "conv_id", "left").select(
        F.lit("qposneg").alias("file"), F.col("conv_id").alias("line_no"),
        F.to_json(F.struct("query", F.col("answers").alias("pos"),
                           F.coalesce("_neg", F.array().cast("array<string>")).alias("neg"))).alias("value"))
    return lp.unionByName(lt).unionByName(st).unionByName(qp).unionByName(qpn)


LINES_SQL = f"""{PAIR_SQL},
{CONV_SQL},
lines AS (
  SELECT 'list_pairs' AS file, doc_id AS line_no, to_json([anc, pos])::VARCHAR AS value FROM pair
  UNION ALL
  SELECT 'list_triples', p.doc_id, to_json(CASE WHEN n.anc IS NULL THEN [p.anc, p.pos] ELSE [p.anc, p.pos, n.anc] END)::VARCHAR
  FROM pair p LEFT JOIN pair n ON n.subset = p.subset AND n.id = p.id + 1
  UNION ALL
  SELECT 'sets', doc_id, to_json({{'set': string_split(text, chr(10))}})::VARCHAR FROM documents
  UNION ALL
  SELECT 'qpos', conv_id, to_json({{'query': query, 'pos': answers}})::VARCHAR FROM conv
  UNION ALL
  SELECT 'qposneg', c.conv_id, to_json({{'query': c.query, 'pos': c.answers, 'neg': coalesce(n.answers, CAST([] AS VARCHAR[]))}})::VARCHAR
  FROM conv c LEFT JOIN conv n ON n.conv_id = c.conv_id + 1)"""


# ---------- TRIPLET fixture: negatives = anchors of the next two rows of the subset ----------

def triplets(t: Tables) -> DataFrame:
    return t.memo("triplets", lambda: _triplets(t))


def _triplets(t: Tables) -> DataFrame:
    """(anc, pos, neg[], label, subset, id): neg = [anc(id+1), anc(id+2)] (missing ones stay NULL)."""
    p = pairs(t)
    n1 = p.select("subset", (F.col("id") - 1).alias("id"), F.col("anc").alias("_n1"))
    n2 = p.select("subset", (F.col("id") - 2).alias("id"), F.col("anc").alias("_n2"))
    j = p.join(n1, ["subset", "id"], "left").join(n2, ["subset", "id"], "left")
    return j.select("anc", "pos", F.array("_n1", "_n2").alias("neg"), "label", "subset", "id")


TRIP_SQL = f"""{PAIR_SQL},
trip AS (
  SELECT p.anc, p.pos, [n1.anc, n2.anc] AS neg, p.label, p.subset, p.id
  FROM pair p LEFT JOIN pair n1 ON n1.subset = p.subset AND n1.id = p.id + 1
              LEFT JOIN pair n2 ON n2.subset = p.subset AND n2.id = p.id + 2)"""


# ---------- R6: queries / corpus / qrels from conversations ----------

def beir(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    return t.memo("beir", lambda: _beir(t))


def _beir(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """queries(_id, text) = first user turn; corpus(_id, title, text) = assistant turns (id conv·1000+turn);
    qrels(query-id, corpus-id) = the conversation's assistant turns plus ids that exist on one side only."""
    qa = conv_qa(t)
    queries = qa.select(F.col("conv_id").alias("_id"), F.col("query").alias("text"))
    a = t.conversations.filter(F.col("role") == "assistant")
    corpus = a.select((F.col("conv_id") * 1000 + F.col("turn")).alias("_id"), first_line(F.col("text")).alias("title"),
                      F.coalesce(rest_lines(F.col("text")), F.lit("")).alias("text"))
    real = a.select(F.col("conv_id").alias("query-id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("corpus-id"))
    ghost_doc = qa.select(F.col("conv_id").alias("query-id"), (F.col("conv_id") * 1000 + 999).alias("corpus-id"))
    ghost_q = qa.select((-(F.col("conv_id") + 1)).alias("query-id"), (F.col("conv_id") * 1000 + 1).alias("corpus-id"))
    return queries, corpus, real.unionByName(ghost_doc).unionByName(ghost_q)


BEIR_SQL = f"""{CONV_SQL},
queries AS (SELECT conv_id AS _id, query AS text FROM conv),
corpus AS (SELECT conv_id * 1000 + turn AS _id, {S.first_line('text')} AS title, coalesce({S.rest_lines('text')}, '') AS text
           FROM conversations WHERE role = 'assistant'),
qrels AS (SELECT conv_id AS "query-id", conv_id * 1000 + turn AS "corpus-id" FROM conversations WHERE role = 'assistant'
          UNION ALL SELECT conv_id, conv_id * 1000 + 999 FROM conv
          UNION ALL SELECT -(conv_id + 1), conv_id * 1000 + 1 FROM conv)"""


# ---------- vectors for loss / geometry queries ----------

def loss_inputs(t: Tables, per_batch: int = 16, student_dim: int = 32) -> DataFrame:
    return t.memo(("loss_inputs", per_batch, student_dim), lambda: _loss_inputs(t, per_batch, student_dim))


def _loss_inputs(t: Tables, per_batch: int = 16, student_dim: int = 32) -> DataFrame:
    """Per anchor: batch_id = vec_id div 16, row_in_batch, teacher = embedding, student = components 33..64,
    positive = next vector of the same label, negative = vector vec_id + 16 (when present).

    The student takes the second half so that a teacher truncated to 32 dims differs from it.
    """
    e = t.embeddings.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    e = range_row_index(e, [("vec_id", True)], out="_p", group=["label"])
    nxt = e.select("label", (F.col("_p") - 1).alias("_p"), F.col("v").alias("pos_v"), F.col("vec_id").alias("pos_id"))
    neg = e.select((F.col("vec_id") - per_batch).alias("vec_id"), F.col("v").alias("neg_v"))
    j = e.join(nxt, ["label", "_p"]).join(neg, "vec_id", "left")
    st = lambda c: F.slice(c, student_dim + 1, student_dim)
    return j.select(
        "vec_id", "label", F.floor(F.col("vec_id") / per_batch).cast("bigint").alias("batch_id"),
        (F.col("vec_id") % per_batch).cast("int").alias("row_in_batch"),
        F.col("v").alias("teacher"), st(F.col("v")).alias("student"), "pos_id",
        F.col("pos_v").alias("pos_teacher"), st(F.col("pos_v")).alias("pos_student"),
        F.col("neg_v").alias("neg_teacher"), F.when(F.col("neg_v").isNotNull(), st(F.col("neg_v"))).alias("neg_student"))


def next_of_label(t: Tables) -> DataFrame:
    """``vec_id, pos_id`` of ``loss_inputs``, without its vectors: only ids and labels are numbered and joined."""
    e = range_row_index(t.embeddings.select("vec_id", "label"), [("vec_id", True)], out="_p", group=["label"])
    return e.join(e.select("label", (F.col("_p") - 1).alias("_p"), F.col("vec_id").alias("pos_id")), ["label", "_p"]).select("vec_id", "pos_id")


LOSS_IN_SQL = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v,
                 row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS p FROM embeddings),
li AS (SELECT a.vec_id, a.label, a.vec_id // 16 AS batch_id, CAST(a.vec_id % 16 AS INT) AS row_in_batch,
              a.v AS teacher, a.v[33:64] AS student, n.vec_id AS pos_id, n.v AS pos_teacher, n.v[33:64] AS pos_student,
              g.v AS neg_teacher, g.v[33:64] AS neg_student
       FROM e a JOIN e n ON n.label = a.label AND n.p = a.p + 1 LEFT JOIN e g ON g.vec_id = a.vec_id + 16)"""


NEG_STEPS = (16, 32, 48)


def loss_inputs_multi(t: Tables, student_dim: int = 32) -> DataFrame:
    """``loss_inputs`` with up to three negatives a row: the vectors vec_id + 16, + 32 and + 48 that exist, in this order."""
    e = t.embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    out = loss_inputs(t)
    for n, step in enumerate(NEG_STEPS):
        out = out.join(e.select((F.col("vec_id") - step).alias("vec_id"), F.col("v").alias(f"_n{n}")), "vec_id", "left")
    lists = F.array_compact(F.array(*[f"_n{n}" for n in range(len(NEG_STEPS))]))
    out = out.withColumn("neg_teacher", lists).drop(*[f"_n{n}" for n in range(len(NEG_STEPS))])
    return out.withColumn("neg_student", F.transform("neg_teacher", lambda v: F.slice(v, student_dim + 1, student_dim)))


# ---------- benchmark scores from events ----------

# fixed list used to name synthetic benchmark tasks (event type + one of these, chosen by event_id)
TASK_SUFFIXES = ["Retrieval", "Reranking", "Classification", "PairClassification", "STS", "Clustering",
                 "Summarization", "DupQuestions", "Quora", "Bitext"]


def _task_col() -> F.Column:
    suf = F.array(*[F.lit(s) for s in TASK_SUFFIXES])
    cap = F.concat(F.upper(F.substring("event_type", 1, 1)), F.substring("event_type", 2, 100))
    return F.concat(cap, F.element_at(suf, (F.col("event_id") % len(TASK_SUFFIXES) + 1).cast("int")))


def run_configs(t: Tables) -> DataFrame:
    return t.memo("run_configs", lambda: _run_configs(t))


def _run_configs(t: Tables) -> DataFrame:
    e = t.events
    g = e.groupBy("user_id").agg(
        F.min_by("event_type", "event_id").alias("data_name"),
        F.countDistinct("event_type").alias("num_epochs"),
        F.sum("value").alias("_sum"), F.max("value").alias("_max"), F.count(F.lit(1)).alias("_n"),
        F.sum((F.col("event_type") == "error").cast("int")).alias("_err"),
        F.sum((F.col("event_type") == "click").cast("int")).alias("_clk"),
        F.sum((F.col("event_type") == "view").cast("int")).alias("_view"))
    return g.select(
        F.concat(F.lit("run"), F.col("user_id").cast("string")).alias("run_name"), "data_name", "num_epochs",
        F.lit(16).alias("batch_size"), F.when(F.col("_sum") > 3000, 2).otherwise(1).alias("world_size"),
        F.when(F.col("_max") > 200, 256).alias("global_batch_size"), F.lit("cosine").alias("scheduler"),
        F.lit("2e-05").alias("lr"), F.when(F.col("_err") > 10, "kld").otherwise("ckd").alias("loss_type"),
        F.when(F.col("_n") % 2 == 0, 0.5).otherwise(1.0).alias("distill_weight"), (F.col("_clk") > 10).alias("use_pos"),
        (F.col("_view") > 10).alias("add_prefix"), F.lit(False).alias("use_lora"))


def score_rows(t: Tables) -> DataFrame:
    return t.memo("score_rows", lambda: _score_rows(t))


def _score_rows(t: Tables) -> DataFrame:
    """(run_name, code_name, task, score): score = mean value of the run's events of that task."""
    from ..operators.scores import run_code_name
    cfg = run_configs(t)
    cfg = cfg.select("run_name", run_code_name(cfg).alias("code_name"))
    s = t.events.select(F.concat(F.lit("run"), F.col("user_id").cast("string")).alias("run_name"), _task_col().alias("task"), "value")
    s = s.groupBy("run_name", "task").agg(F.avg("value").alias("score"))
    return s.join(cfg, "run_name").select("run_name", "code_name", "task", "score")


def task_tables(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    return t.memo("task_tables", lambda: _task_tables(t))


def _task_tables(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tasks, overrides, metadata), one row per task."""
    tasks = t.events.select(_task_col().alias("task")).distinct()
    overrides = tasks.filter(F.col("task").like("Click%Clustering")).select("task", F.lit("Classification").alias("category"))
    metadata = tasks.filter(F.col("task").like("View%")).select("task", F.lit("Retrieval").alias("category"))
    return tasks, overrides, metadata


def _suffix_sql() -> str:
    return "[" + ", ".join(f"'{s}'" for s in TASK_SUFFIXES) + "]"


TASK_SQL = f"upper(substr(event_type, 1, 1)) || substr(event_type, 2) || {_suffix_sql()}[event_id % {len(TASK_SUFFIXES)} + 1]"
CFG_SQL = """cfg AS (
  SELECT 'run' || user_id AS run_name, arg_min(event_type, event_id) AS data_name, count(DISTINCT event_type) AS num_epochs,
         16 AS batch_size, CASE WHEN sum(value) > 3000 THEN 2 ELSE 1 END AS world_size,
         CASE WHEN max(value) > 200 THEN 256 END AS global_batch_size, 'cosine' AS scheduler, '2e-05' AS lr,
         CASE WHEN count(*) FILTER (WHERE event_type = 'error') > 10 THEN 'kld' ELSE 'ckd' END AS loss_type,
         CASE WHEN count(*) % 2 = 0 THEN 0.5 ELSE 1.0 END AS distill_weight,
         count(*) FILTER (WHERE event_type = 'click') > 10 AS use_pos, count(*) FILTER (WHERE event_type = 'view') > 10 AS add_prefix,
         false AS use_lora
  FROM events GROUP BY user_id),
cn AS (SELECT run_name, data_name || '_e' || num_epochs || '_bs' || coalesce(global_batch_size, batch_size * world_size) || '_' ||
              scheduler || lr || '_' || loss_type || CASE WHEN distill_weight <> 1.0 THEN CAST(CAST(distill_weight AS DOUBLE) AS VARCHAR) ELSE '' END ||
              CASE WHEN use_pos THEN '_w-pos' ELSE '' END || CASE WHEN add_prefix THEN '_prefix' ELSE '' END ||
              CASE WHEN use_lora THEN '_lora' ELSE '' END AS code_name FROM cfg)"""
SCORES_SQL = f"""{CFG_SQL},
sc AS (SELECT s.run_name, cn.code_name, s.task, s.score
       FROM (SELECT 'run' || user_id AS run_name, {TASK_SQL} AS task, avg(value) AS score FROM events GROUP BY 1, 2) s
       JOIN cn USING (run_name)),
tasks AS (SELECT DISTINCT {TASK_SQL} AS task FROM events),
overrides AS (SELECT task, 'Classification' AS category FROM tasks WHERE task LIKE 'Click%Clustering'),
metadata AS (SELECT task, 'Retrieval' AS category FROM tasks WHERE task LIKE 'View%')"""
