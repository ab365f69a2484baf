"""Pair / triplet shaping, flattening to one row per text, and regrouping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def with_instruction(df: DataFrame, instructions: DataFrame | None, subset: str = "subset") -> DataFrame:
    """Attach ``instruction`` (per-subset map; missing → ''). The map has one row per subset."""
    if instructions is None:
        return df.withColumn("instruction", F.lit(""))
    ins = instructions.select(F.col("subset").alias(subset), F.col("instruction").alias("_ins"))
    # one row per subset name: bounded by the subset count, broadcast
    return df.join(F.broadcast(ins), subset, "left").withColumn("instruction", F.coalesce("_ins", F.lit(""))).drop("_ins")


def instruct(text, instruction):
    """``Instruct:{i}\\nQuery:{t}`` when the instruction is non-empty, else the text."""
    return F.when(F.length(instruction) > 0, F.concat(F.lit("Instruct:"), instruction, F.lit("\nQuery:"), text)).otherwise(text)


def flatten_pairs(pairs: DataFrame, instructions: DataFrame | None = None) -> DataFrame:
    """(anc, pos, subset, id) → (text, subset, id, column, len); the instruction goes on anchors only."""
    p = with_instruction(pairs, instructions)
    p = p.withColumn("_anc", instruct(F.coalesce("anc", F.lit("")), F.col("instruction")))
    ex = p.select(
        "subset",
        "id",
        F.explode(F.array(
            F.struct(F.lit("anc").alias("column"), F.col("_anc").alias("text")),
            F.struct(F.lit("pos").alias("column"), F.coalesce("pos", F.lit("")).alias("text")),
        )).alias("_x"),
    )
    return ex.select(F.col("_x.text").alias("text"), "subset", "id", F.col("_x.column").alias("column"),
                     F.length("_x.text").cast("bigint").alias("len"))


def flatten_triplets(trip: DataFrame, instructions: DataFrame | None = None) -> DataFrame:
    """(anc, pos, neg[], label, subset, id) → (text, subset, id, column, slot, label, len).

    ``slot`` is the negative's position in ``neg`` (-1 for anc/pos); NULL negatives are skipped.
    """
    p = with_instruction(trip, instructions)
    p = p.withColumn("_anc", instruct(F.coalesce("anc", F.lit("")), F.col("instruction")))
    # one generator over the row's own texts: the input is planned and read once
    part = lambda column, slot, text: F.struct(F.lit(column).alias("column"), slot.cast("int").alias("slot"), text.alias("text"))
    negs = F.transform("neg", lambda t, i: part("neg", i, t))
    kept = F.filter(negs, lambda x: x["text"].isNotNull())
    own = F.array(part("anc", F.lit(-1), F.col("_anc")), part("pos", F.lit(-1), F.coalesce("pos", F.lit(""))))
    out = p.select("subset", "id", "label", F.explode(F.when(F.col("neg").isNull(), own).otherwise(F.concat(own, kept))).alias("_x"))
    return out.select("_x.text", "subset", "id", "_x.column", "_x.slot", "label", F.length("_x.text").cast("bigint").alias("len"))


def regroup_pairs(flat: DataFrame) -> DataFrame:
    """Encoded flat rows (text, subset, id, column, emb_idx) → (anc, pos, anc_emb_idx, pos_emb_idx, subset, id).

    Keys missing either side are dropped (count them with :func:`incomplete_pairs`).
    """
    g = flat.groupBy("subset", "id").agg(
        F.max(F.when(F.col("column") == "anc", F.struct("text", "emb_idx"))).alias("_a"),
        F.max(F.when(F.col("column") == "pos", F.struct("text", "emb_idx"))).alias("_p"),
    )
    g = g.filter(F.col("_a").isNotNull() & F.col("_p").isNotNull())
    return g.select(F.col("_a.text").alias("anc"), F.col("_p.text").alias("pos"),
                    F.col("_a.emb_idx").alias("anc_emb_idx"), F.col("_p.emb_idx").alias("pos_emb_idx"), "subset", "id")


def incomplete_pairs(flat: DataFrame) -> DataFrame:
    g = flat.groupBy("subset", "id").agg(
        F.max((F.col("column") == "anc").cast("int")).alias("a"), F.max((F.col("column") == "pos").cast("int")).alias("p"))
    return g.filter((F.col("a") == 0) | (F.col("p") == 0)).agg(F.count(F.lit(1)).alias("incomplete"))


def regroup_triplets(flat: DataFrame) -> DataFrame:
    """Encoded flat rows with slots → ENCODED (negatives in slot order, label from anc else pos, neg_num)."""
    g = flat.groupBy("subset", "id").agg(
        F.max(F.when(F.col("column") == "anc", F.struct("text", "emb_idx", "label"))).alias("_a"),
        F.max(F.when(F.col("column") == "pos", F.struct("text", "emb_idx", "label"))).alias("_p"),
        F.array_sort(F.collect_list(F.when(F.col("column") == "neg", F.struct("slot", "text", "emb_idx")))).alias("_n"),
    )
    g = g.filter(F.col("_a").isNotNull() & F.col("_p").isNotNull())
    return g.select(
        F.col("_a.text").alias("anc"), F.col("_p.text").alias("pos"),
        F.transform("_n", lambda x: x["text"]).alias("neg"),
        F.coalesce(F.col("_a.label"), F.col("_p.label")).alias("label"),
        F.col("_a.emb_idx").alias("anc_emb_idx"), F.col("_p.emb_idx").alias("pos_emb_idx"),
        F.transform("_n", lambda x: x["emb_idx"]).alias("neg_emb_idx"),
        "subset", "id", F.size("_n").cast("bigint").alias("neg_num"),
    )
