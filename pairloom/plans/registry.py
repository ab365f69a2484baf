"""Name → (Spark builder, DuckDB oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import Tables

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def load_all() -> None:
    from . import q_batches, q_files, q_flat, q_joins, q_losses, q_scores, q_shapes, q_sources, q_text, q_triplets, q_vectors  # noqa: F401


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load_all()
    return {name: (lambda spark, sf_dir, _f=fn: _f(Tables(spark, sf_dir))) for name, fn in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    load_all()
    return dict(ORACLES)
