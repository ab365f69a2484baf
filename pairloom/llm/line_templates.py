"""Line deduplication by log templates (operator 9).

Lines are parsed by a tree of fixed depth: the number of tokens, then the leading tokens, tokens with a digit counting as the field
``<*>``. In a leaf, a token that few lines carry at its place is a variable field:

* the leaf's main template has at each place the most frequent token, if enough lines carry it; a line belongs to it when it
  carries these tokens at ``SIMILAR`` of the places after the leading tokens or more, one of them without a digit;
* any other line is generalised by itself: its rare tokens become fields, and if at least ``SIMILAR`` of the places after the leading
  tokens stay fixed, one of them without a digit, the result is its template, else the line (with its digit fields) is.

The leading tokens alone, which all lines of a leaf share, make no template. A line whose tokens all have digits is itself and has no fields.

A template recurs when its lines stand in ``MIN_DOCS`` different surroundings or more. The surrounding of a line is the smallest hash
among the other lines of its document that stand in fewer than ``MIN_DOCS`` different texts; without such a line it is the hash of the set of the
document's lines. Blank lines take no part. So copies of a document count once, and lines that recur together don't hide each other. Near copies count
each when ``MIN_DOCS`` or more of them share their lines and differ elsewhere. Every line of a recurring template is
dropped but its first one (smallest id, then place).

Blank lines and lines of fewer than ``MIN_TOKENS`` tokens are never dropped, and a document keeps its place even when no line is left
(its text is then empty). A null text stays null. Rows with equal id and text are one document, so both keep or lose
the same lines. Extra columns stay as they are; the text column alone changes.

Counts go by (line hash, surrounding) and only leaves that can recur are looked at with their tokens, so a hot line or leaf is
summed before it is shuffled and no leaf is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_folder, table

DEPTH, MIN_TOKENS, MIN_DOCS, SIMILAR = 3, 3, 3, 0.6


def line_rows(docs: DataFrame, key: str, text: str, depth: int, min_tokens: int) -> DataFrame:
    """``id, text_hash, place, leaf, line, masked``: the parsed lines that are not blank; ``place`` counts from 0, lines of few tokens have no leaf."""
    t = F.col(text).cast("string")
    rows = docs.where(t.isNotNull()).select(F.col(key).cast("long").alias("id"), F.xxhash64(t).alias("text_hash"), t.alias("text"))
    # an outer generator gets no inferred filter that splits the text again
    rows = rows.select("id", "text_hash", F.posexplode_outer(F.split("text", "\n")).alias("place", "raw"))
    rows = rows.select("id", "text_hash", "place", masked_line(F.col("raw")).alias("masked")).where(F.col("masked") != "")
    tokens = F.length("masked") - F.length(F.replace("masked", F.lit(" "))) + 1
    leaf = F.when(tokens >= min_tokens, F.xxhash64(tokens, F.substring_index("masked", " ", depth)))
    return rows.select("id", "text_hash", "place", leaf.alias("leaf"), F.xxhash64("masked").alias("line"), "masked")


def masked_line(x):
    """A trimmed line with tabs as blanks and ``<*>`` for each token that has a digit."""
    flat = F.trim(F.when(F.contains(x, F.lit("\t")) | F.contains(x, F.lit("\r")), F.regexp_replace(x, "[\t\r]", " ")).otherwise(x))
    masked = F.when(F.rlike(x, F.lit("[0-9]")), F.regexp_replace(flat, r"\S*[0-9]\S*", "<*>")).otherwise(flat)
    return F.when(F.rlike(masked, F.lit(r"^(<\*> *)+$")), flat).otherwise(masked)


def surroundings(lines: DataFrame, folder: str, min_docs: int) -> DataFrame:
    """Distinct ``leaf, line, surrounding`` of the parsed ``lines``; documents of one set of lines are one."""
    sets = lines.groupBy("id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("line", F.col("leaf").alias("leaf")))).alias("lines"))
    whole = sets.groupBy(F.xxhash64(F.transform("lines", lambda x: x["line"])).alias("whole")).agg(F.first("lines").alias("lines"))
    texts = kept_table(whole.select("whole", F.explode_outer("lines").alias("l")).select("whole", "l.leaf", "l.line").where(F.col("leaf").isNotNull()), folder, "texts")
    common = kept_table(texts.groupBy("line").count().where(F.col("count") >= min_docs).select("line"), folder, "common")
    rare = texts.join(common, "line", "left_anti").groupBy("whole").agg(F.slice(F.sort_array(F.collect_set("line")), 1, 2).alias("m"))
    first = F.get("m", F.lit(0))
    other = F.when(F.col("line") == first, F.get("m", F.lit(1))).otherwise(first)
    return texts.join(rare, "whole", "left").select("leaf", "line", F.coalesce(other, "whole").alias("surrounding")).distinct()


def kept_table(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Writes a step in the shared folder and reads it again, so that later joins know its size."""
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def templates(found: DataFrame, min_docs: int, similar: float, depth: int) -> DataFrame:
    """``line, template`` by the tokens' support in each (leaf, place). ``found``: ``leaf, line, masked, n``."""
    tokens = found.select("leaf", "line", "n", F.posexplode(F.split("masked", " ")).alias("at", "token"))
    support = tokens.groupBy("leaf", "at", "token").agg(F.sum("n").alias("support"))
    main = support.groupBy("leaf", "at").agg(F.max(F.struct("support", "token")).alias("top")).where(F.col("top.support") >= min_docs).select(
        "leaf", "at", F.col("top.token").alias("main"))
    marked = tokens.join(support, ["leaf", "at", "token"]).join(main, ["leaf", "at"], "left")
    frequent, after = F.col("support") >= min_docs, F.col("at") >= depth
    word = after & ~F.rlike("token", F.lit(r"[0-9]|^<\*>$"))
    same = F.coalesce(F.col("token") == F.col("main"), F.lit(False))
    rows = marked.groupBy("leaf", "line").agg(
        F.count_if(after).alias("size"), F.count_if(same & after).alias("same"), F.count_if(same & word).alias("same_words"),
        F.count_if(frequent & after).alias("fixed"), F.count_if(frequent & word).alias("fixed_words"),
        F.sort_array(F.collect_list(F.struct("at", F.when(frequent, F.col("token")).otherwise("<*>").alias("token")))).alias("fields"))
    own = F.when((F.col("fixed") >= similar * F.col("size")) & (F.col("fixed_words") > 0), F.xxhash64("leaf", F.col("fields.token"))).otherwise(F.col("line"))
    return rows.select("line", F.when((F.col("same") >= similar * F.col("size")) & (F.col("same_words") > 0), F.xxhash64("leaf", F.lit("main"))).otherwise(own).alias("template"))


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", depth: int = DEPTH, min_tokens: int = MIN_TOKENS,
                   min_docs: int = MIN_DOCS, similar: float = SIMILAR) -> DataFrame:
    """``id, text_hash, dropped``: per document the places of lines to drop (documents without such lines are absent)."""
    folder = shared_folder(docs.sparkSession, "lines")
    lines = kept_table(line_rows(docs, key, text, depth, min_tokens), folder, "lines")
    seen = kept_table(surroundings(lines, folder, min_docs), folder, "seen")
    counted = seen.groupBy("leaf", "line").agg(F.count("*").alias("n"))
    leaves = counted.groupBy("leaf").agg(F.sum("n").alias("total"), F.count("*").alias("lines")).where(
        (F.col("total") >= min_docs) & (F.col("lines") > 1)).select("leaf")
    leaves = kept_table(leaves, folder, "leaves")
    texts = lines.select("leaf", "line", "masked").join(leaves, "leaf", "left_semi").groupBy("leaf", "line").agg(F.first("masked").alias("masked"))
    found = kept_table(texts.join(counted, ["leaf", "line"]), folder, "found")
    names = kept_table(templates(found, min_docs, similar, depth), folder, "templates")
    named = seen.join(names, "line", "left").withColumn("template", F.coalesce("template", "line"))
    recurring = named.groupBy("template", "surrounding").agg(F.lit(1).alias("one")).groupBy("template").count().where(F.col("count") >= min_docs).select("template")
    bad = named.join(recurring, "template", "left_semi").select("line", "template").distinct()
    bad = kept_table(bad, folder, "recurring")
    hits = kept_table(lines.select("id", "text_hash", "place", "line").join(bad, "line").select("id", "text_hash", "place", "template"), folder, "hits")
    first = hits.groupBy("template").agg(F.min(F.struct("id", "text_hash", "place")).alias("first"))
    first = first.select(F.col("first.id").alias("first_id"), F.col("first.text_hash").alias("first_hash"), F.col("first.place").alias("first_place"))
    same = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash")) & (F.col("place") == F.col("first_place"))
    drop = hits.join(first, same, "left_anti")  # by row, so a frequent template is no hot key
    return drop.groupBy("id", "text_hash").agg(F.collect_set("place").alias("dropped"))


def drop_templates(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The columns of ``docs`` with the cleaned text, then ``__lines`` and ``__dropped`` (sorted places); columns of ``docs`` with these two names are replaced."""
    docs = docs.drop("__lines", "__dropped")
    drops = repeated_lines(docs, key, text, **options).select(F.col("id").alias("__drop_id"), F.col("text_hash").alias("__drop_hash"), F.sort_array("dropped").alias("__dropped"))
    names = {c: f"__own_{i}" for i, c in enumerate(docs.columns)}
    own = docs.select(*[docs[c].alias(n) for c, n in names.items()])
    t = F.col(names[text]).cast("string")
    joined = own.join(drops, F.col(names[key]).cast("long").eqNullSafe(F.col("__drop_id")) & (F.xxhash64(t) == F.col("__drop_hash")), "left")
    lines = F.split(t, "\n")
    clean = F.when(F.col("__dropped").isNull(), t).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("__dropped", i)), "\n"))
    none = F.array().cast("array<int>")
    return joined.select(*[(clean if c == text else F.col(n)).alias(c) for c, n in names.items()],
                         F.coalesce(F.size(lines), F.lit(0)).alias("__lines"), F.coalesce("__dropped", none).alias("__dropped"))


def op9_line_templates(spark, sf_dir: str) -> DataFrame:
    out = drop_templates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__lines").cast("long").alias("n_lines"), F.size("__dropped").cast("long").alias("n_dropped"), F.col("__dropped").alias("dropped"), "text")
