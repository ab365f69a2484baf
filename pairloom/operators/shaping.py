"""Raw JSONL shapes → (anc, pos, neg) rows (S1, P1–P4, P6) and record normalisation.

A "file" is a group of lines; its shape comes from its first line, as in the reference:
list rows ``[anc, pos(, neg)]``, ``{"set": [...]}``, ``{"query", "pos": [...]}``,
``{"query", "pos": [...], "neg": [...]}``. Any other first line (blank and broken ones too), or a later line of another
shape, fails the job, whichever columns are selected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_strip
from ..session import cut_lineage
from .indexing import MAX_BROADCAST_GROUPS, null_safe_join

FILE_SALTS = 64
SHAPES = ("list", "pos,query", "neg,pos,query", "set")


def row_shape(value: Column) -> Column:
    v = py_strip(value)
    keys = F.array_join(F.array_sort(F.json_object_keys(v)), ",")
    return F.when(v.startswith("["), F.lit("list")).otherwise(keys)


def shape_jsonl(lines: DataFrame, file: str = "file", line_no: str = "line_no", value: str = "value") -> DataFrame:
    """(file, line_no, value) → (file, line_no, item, anc, pos, neg)."""
    d = lines.select(F.col(file).alias("file"), F.col(line_no).alias("line_no"), F.col(value).alias("value"))
    # a blank or broken line has no keys: its shape is the empty name, which is never expected
    d = d.withColumn("_rs", F.coalesce(row_shape(F.col("value")), F.lit("")))
    # one row per file; a NULL file name is a file of its own
    firsts = cut_lineage(d.groupBy("file").agg(F.min_by("_rs", "line_no").alias("_fs")))
    if firsts.count() <= MAX_BROADCAST_GROUPS:
        d = null_safe_join(d, F.broadcast(firsts), ["file"])
    else:  # the lines of a file are dealt to several tasks
        salts = F.explode(F.sequence(F.lit(0), F.lit(FILE_SALTS - 1)))
        d = d.withColumn("_salt", F.pmod(F.xxhash64("line_no", "value"), F.lit(FILE_SALTS)).cast("int"))
        d = null_safe_join(d, firsts.withColumn("_salt", salts), ["file", "_salt"])
    name = F.coalesce(F.col("file").cast("string"), F.lit("NULL"))
    # the check is a filter, so no choice of output columns can prune it away
    d = d.filter(
        F.when(~F.col("_fs").isin(*SHAPES),
               F.raise_error(F.concat(F.lit("unexpected keys in file "), name, F.lit(": "), F.col("_fs"))).cast("boolean"))
        .when(F.col("_fs") != F.col("_rs"),
              F.raise_error(F.concat(F.lit("mixed shapes in file "), name, F.lit(": "), F.col("_rs"))).cast("boolean"))
        .otherwise(F.lit(True)))
    fs = F.col("_fs")
    arr = F.from_json("value", "array<string>")
    obj = F.from_json("value", "struct<set: array<string>, query: string, pos: array<string>, neg: array<string>>")
    d = d.withColumn("_a", arr).withColumn("_o", obj)
    # one array of (anc, pos, neg) structs per line, then a single explode
    pair = "struct<anc: string, pos: string, neg: string>"
    lst = F.array(F.struct(F.try_element_at("_a", F.lit(1)).alias("anc"), F.try_element_at("_a", F.lit(2)).alias("pos"),
                           F.when(F.size("_a") > 2, F.try_element_at("_a", F.lit(3))).alias("neg")))
    s = F.col("_o.set")
    sets = F.transform(F.sequence(F.lit(0), F.floor(F.size(s) / 2).cast("int") - 1),
                       lambda i: F.struct(s[i].alias("anc"), s[i + 1].alias("pos"), F.lit(None).cast("string").alias("neg")))
    sets = F.when(F.size(s) >= 2, sets).otherwise(F.array().cast(f"array<{pair}>"))
    q, p, n = F.col("_o.query"), F.col("_o.pos"), F.col("_o.neg")
    qpos = F.transform(p, lambda x: F.struct(q.alias("anc"), x.alias("pos"), F.lit(None).cast("string").alias("neg")))
    qposneg = F.transform(p, lambda x, i: F.struct(q.alias("anc"), x.alias("pos"),
                                                   F.when(F.size(n) > 0, n[F.least(i, F.size(n) - 1)]).alias("neg")))
    items = (F.when(fs == "list", lst).when(fs == "set", sets).when(fs == "pos,query", qpos)
             .when(fs == "neg,pos,query", qposneg))
    d = d.select("file", "line_no", F.posexplode(F.coalesce(items, F.array().cast(f"array<{pair}>"))).alias("item", "_x"))
    return d.select("file", "line_no", F.col("item").cast("bigint").alias("item"), "_x.anc",
                    "_x.pos", "_x.neg")


def selected_passages(df: DataFrame) -> DataFrame:
    """(query, query_id, passages{passage_text[], is_selected[]}) → (query_id, anc, pos) for selected passages."""
    z = df.select("query_id", "query", F.explode(F.arrays_zip(F.col("passages.passage_text").alias("t"),
                                                             F.col("passages.is_selected").alias("s"))).alias("_z"))
    return z.filter(F.col("_z.s") == 1).select("query_id", F.col("query").alias("anc"), F.col("_z.t").alias("pos"))


def lenient_list(c: Column) -> Column:
    """A JSON/Python-literal list string → array; blank, NULL or non-list → empty array."""
    parsed = F.from_json(c, "array<string>", {"allowSingleQuotes": "true"})
    return F.coalesce(parsed, F.array().cast("array<string>"))


def triplet_schema(df: DataFrame, pair_only: bool = False, keep: Sequence[Column] = ()) -> DataFrame:
    """P14 + P15: normalise to TRIPLET (anc, pos, neg[], label, subset) with column fallbacks.

    anc ← anc else query else text, pos ← pos else document; NULL → ''; negatives come from the column ``negs``,
    where there is none from ``neg``; scalar neg → [neg]; NULL neg → [];
    a pair source (``pair_only``) discards its negatives. ``keep``: further columns of the result.
    """
    cols = set(df.columns)

    def pick(*names: str) -> Column:
        present = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in cols]
        return F.coalesce(*present, F.lit("")) if present else F.lit("")

    source = next((n for n in ("negs", "neg") if n in cols), None)
    if pair_only or source is None:
        neg = F.array().cast("array<string>")
    elif df.schema[source].dataType.typeName() == "array":
        neg = F.coalesce(F.col(source).cast("array<string>"), F.array().cast("array<string>"))
    else:
        neg = F.when(F.col(source).isNull(), F.array().cast("array<string>")).otherwise(F.array(F.col(source).cast("string")))
    label = F.coalesce(F.col("label").cast("string"), F.lit("")) if "label" in cols else F.lit("")
    subset = F.col("subset").cast("string") if "subset" in cols else F.lit("")
    return df.select(pick("anc", "query", "text").alias("anc"), pick("pos", "document").alias("pos"), neg.alias("neg"),
                     label.alias("label"), subset.alias("subset"), *keep)
