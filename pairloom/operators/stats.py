"""Statistics and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .indexing import null_safe_join


def length_stats(df: DataFrame, len_col: str = "len", group: Sequence[str] = ()) -> DataFrame:
    """G1: count, min, max, mean, median, population std, p25, p75 (linear interpolation).

    Exact percentiles keep one counter per distinct length value (bounded by the longest text),
    merged map-side, so no group's rows are ever gathered in one place.
    """
    x = F.col(len_col)
    aggs = [
        F.count(x).alias("count"), F.min(x).cast("bigint").alias("min"), F.max(x).cast("bigint").alias("max"),
        F.round(F.avg(x), 6).alias("mean"), F.round(F.percentile(x, 0.5), 6).alias("median"),
        F.round(F.stddev_pop(x), 6).alias("std"), F.round(F.percentile(x, 0.25), 6).alias("p25"),
        F.round(F.percentile(x, 0.75), 6).alias("p75"),
    ]
    return df.groupBy(*group).agg(*aggs)


def length_buckets(df: DataFrame, len_col: str = "len", threshold: int = 2048, medium: int | None = 128) -> DataFrame:
    """bucket = long (len > T), medium (m < len ≤ T), short (len ≤ m); two-way when ``medium`` is None."""
    x = F.col(len_col)
    if medium is None:
        b = F.when(x > threshold, "long").otherwise("short")
    else:
        b = F.when(x > threshold, "long").when(x > medium, "medium").otherwise("short")
    return df.withColumn("bucket", b)


def dataset_summary(df: DataFrame, subset: str = "subset", order_key: str = "id", n_samples: int = 10,
                    sample_col: str = "anc") -> DataFrame:
    """Per subset: rows, column names, first ``n_samples`` values of ``sample_col`` by ``order_key``."""
    cols = ",".join(c for c in df.columns if c != subset)
    w = Window.partitionBy(subset).orderBy(order_key)
    # row_number <= n is planned as a per-partition group limit before the shuffle
    top = df.select(subset, order_key, sample_col).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n_samples)
    samples = top.groupBy(subset).agg(F.array_sort(F.collect_list(F.struct("_r", sample_col))).alias("_s"))
    samples = samples.select(subset, F.transform("_s", lambda s: s[sample_col]).alias("sample"))
    counts = df.groupBy(subset).agg(F.count(F.lit(1)).alias("len"))
    return null_safe_join(counts, samples, [subset]).select(subset, "len", F.lit(cols).alias("keys"), "sample")


def neg_histogram(df: DataFrame, subset: str = "subset", neg: str = "neg") -> DataFrame:
    """Rows per (subset, number of negatives)."""
    return df.groupBy(subset, F.coalesce(F.size(neg), F.lit(0)).cast("bigint").alias("n_neg")).agg(
        F.count(F.lit(1)).alias("rows"))


def neg_summary(df: DataFrame, subset: str = "subset", neg: str = "neg") -> DataFrame:
    """Min / max / mean number of negatives per subset."""
    n = F.coalesce(F.size(neg), F.lit(0))
    return df.groupBy(subset).agg(F.min(n).cast("bigint").alias("min_neg"), F.max(n).cast("bigint").alias("max_neg"),
                                  F.round(F.avg(n), 6).alias("mean_neg"))


def mix_summary(df: DataFrame, kind: str = "kind", subset: str = "subset") -> DataFrame:
    """Rows per (kind, subset) with per-kind and grand totals (rollup)."""
    return df.rollup(kind, subset).agg(F.count(F.lit(1)).alias("rows"))
