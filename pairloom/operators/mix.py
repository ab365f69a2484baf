"""Proportional mixing of many sources."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import h
from .indexing import null_safe_join, select_first
from .shaping import triplet_schema


def exclude_subsets(df: DataFrame, excluded: DataFrame | Sequence[str], subset: str = "subset") -> DataFrame:
    """Drop rows of listed subsets (anti-join to an exclusion table, or a literal list); a NULL subset stays unless it is listed."""
    if isinstance(excluded, DataFrame):
        return null_safe_join(df, excluded.select(F.col(excluded.columns[0]).alias(subset)).distinct(), [subset], "left_anti")
    return df.filter(~F.coalesce(F.col(subset).isin(*excluded), F.lit(False)))


def allocation_plan(df: DataFrame, total_target: int, cap: int = 1_000_000, excluded: Sequence[str] = (),
                    subset: str = "subset", replacements: DataFrame | None = None) -> DataFrame:
    """available = min(rows, cap) per subset; ratio = target / Σ available; alloc = min(avail, int(avail·ratio)).

    ``replacements`` (rows tagged with ``subset``) supply the rows of replaced subsets: those subsets count the
    replacement's rows instead of the base table's. One row per subset (aggregated map-side); the ratio is a
    window over that small table.
    """
    base = exclude_subsets(df, list(excluded), subset).select(subset)
    if replacements is not None:
        rep = exclude_subsets(replacements, list(excluded), subset).select(subset)
        base = null_safe_join(base, rep.distinct(), [subset], "left_anti").unionByName(rep)
    sizes = base.groupBy(subset).agg(F.count(F.lit(1)).alias("rows"))
    sizes = sizes.withColumn("len", F.least(F.col("rows"), F.lit(cap))).filter(F.col("len") > 0)
    total = F.sum("len").over(Window.partitionBy())
    ratio = F.when(total > 0, F.lit(float(total_target)) / total).otherwise(F.lit(0.0))
    return sizes.select(subset, "len", F.least(F.col("len"), F.floor(F.col("len") * ratio)).cast("bigint").alias("alloc"))


def build_mix(df: DataFrame, plan: DataFrame, seed: int, key_cols: Sequence[str], subset: str = "subset") -> DataFrame:
    """The sampled part of U2: per subset (NULL is one), the first ``alloc`` rows in hash order, normalised to TRIPLET."""
    return triplet_schema(select_first(df, plan.select(subset, "alloc"), h(seed, *[F.col(k) for k in key_cols]), list(key_cols), [subset], limit="alloc"))


@dataclass(frozen=True)
class MixSource:
    """One source of a mix.

    ``role``: ``planned`` rows are sampled by the allocation plan, ``replacement`` rows stand in for the planned rows of ``subset`` and are
    sampled like them, ``whole`` rows all go in. ``subset`` names the source; None takes it from the rows' own column. Only replacements keep
    their labels. Missing TRIPLET columns fall back as in ``triplet_schema``.
    """

    rows: DataFrame
    role: str = "planned"
    subset: str | None = None

    def normal(self, key_cols: Sequence[str] = ()) -> DataFrame:
        d = self.rows if self.subset is None else self.rows.withColumn("subset", F.lit(self.subset))
        keys = [F.col(k).cast("string").alias(f"__key{i}") for i, k in enumerate(key_cols)]
        return triplet_schema(d if self.role == "replacement" else d.drop("label"), keep=[*keys, F.lit(self.role).alias("role")])


def subset_folders(spark: SparkSession, root: str, kind: str = "parquet") -> DataFrame:
    """All subset folders below ``root`` as one scan; ``subset`` is the name of the folder. Files may lack some columns."""
    files = spark.read.option("mergeSchema", "true").format(kind).load(f"{root.rstrip('/')}/*")
    return files.withColumn("subset", F.url_decode(F.element_at(F.split("_metadata.file_path", "/"), -2)))


def build_full_mix(sources: Sequence[MixSource], total_target: int, seed: int, key_cols: Sequence[str], cap: int = 1_000_000,
                   excluded: Sequence[str] = ()) -> DataFrame:
    """TRIPLET rows and ``role``: the sampled planned and replaced subsets and every whole source, as one union.

    ``key_cols`` identify a planned or replacement row inside its subset and order the sample. Each source is reduced to its
    TRIPLET columns at its scan; the plan reads the subset column alone. A NULL subset is planned like any other.
    """
    unknown = {s.role for s in sources} - {"planned", "replacement", "whole"}
    if unknown or any(s.subset is None for s in sources if s.role == "replacement"):
        raise ValueError(f"unknown roles {sorted(unknown)}, or a replacement without the name of its subset")
    replaced = [s.subset for s in sources if s.role == "replacement"]
    parts = []
    for s in sources:
        if s.role == "planned":
            parts.append(exclude_subsets(s.normal(key_cols), replaced) if replaced else s.normal(key_cols))
        elif s.role == "replacement":
            parts.append(s.normal(key_cols))
    whole = [s.normal() for s in sources if s.role == "whole"]
    names = [f"__key{i}" for i in range(len(key_cols))]
    if parts:
        pool = reduce(DataFrame.unionByName, parts)
        plan = allocation_plan(pool, total_target, cap, excluded)
        order = h(seed, F.col("subset"), *[F.col(k) for k in names])
        whole.insert(0, select_first(pool, plan.select("subset", "alloc"), order, names, ["subset"], limit="alloc").drop(*names))
    if not whole:
        raise ValueError("a mix needs a source")
    return reduce(DataFrame.unionByName, whole)


def full_mix_counts(mix: DataFrame) -> DataFrame:
    """Rows of a full mix by role and subset."""
    return mix.groupBy("role", "subset").agg(F.count(F.lit(1)).alias("rows"))


def mix_kind(df: DataFrame) -> DataFrame:
    return df.withColumn("kind", F.when(F.size("neg") > 0, "triplet").otherwise("pair"))


def concat_rebase(first: DataFrame, second: DataFrame, n_first: int,
                  idx_cols: Sequence[str] = ("anc_emb_idx", "pos_emb_idx"), arr_cols: Sequence[str] = ("neg_emb_idx",)) -> DataFrame:
    """Union two encoded datasets; the second one's vector indices (scalars and arrays) move up by ``n_first``."""
    s = second
    for c in idx_cols:
        if c in s.columns:
            s = s.withColumn(c, F.col(c) + F.lit(n_first))
    for c in arr_cols:
        if c in s.columns:
            s = s.withColumn(c, F.transform(c, lambda x: x + F.lit(n_first)))
    return first.unionByName(s, allowMissingColumns=True)
