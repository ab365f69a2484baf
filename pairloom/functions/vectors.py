"""Vector column expressions (JVM higher-order functions; double arithmetic)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column, eps: float = 0.0) -> Column:
    """``v / (‖v‖ + eps)``; a zero vector stays zero."""
    n = norm(v) + F.lit(eps)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def truncate_dim(v: Column, d: int) -> Column:
    """P20: the first ``d`` components (teacher vector cut to the student's dimension)."""
    return F.slice(v, 1, d)


def sq_dist(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0).cast("double"), lambda acc, x: acc + x)
