"""Compare a Spark query with its DuckDB oracle the way the driver does: row count, column names,
order-insensitive multiset of normalised rows."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
import numpy as np

from pairloom.plans.fixtures import TABLES


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float | np.floating):
        if math.isnan(v):
            return None
        return round(float(v), 5)
    if isinstance(v, np.integer):
        return int(v)
    if isinstance(v, np.ndarray | list | tuple):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return v


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


_SIMPLE = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
           "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT"}


def duck_type(spark_type: str) -> str:
    if spark_type.startswith("array<"):
        return duck_type(spark_type[6:-1]) + "[]"
    return _SIMPLE.get(spark_type, spark_type.upper())


def compare(sdf, con, sql: str) -> tuple[bool, str]:
    con.sql(sql).create_view("oracle_under_test", replace=True)  # as the driver does
    rel0 = con.table("oracle_under_test")
    want = {c: str(t) for c, t in zip(rel0.columns, rel0.types)}
    got = {f.name: duck_type(f.dataType.simpleString()) for f in sdf.schema.fields}
    bad = {c: (got.get(c), want.get(c)) for c in set(got) | set(want) if got.get(c) != want.get(c)}
    if bad:
        return False, f"types differ (spark, duck): {bad}"
    s_cols = sorted(sdf.columns)
    s_rows = [tuple(_norm(r[c]) for c in s_cols) for r in sdf.collect()]
    rel = con.sql(sql)
    d_cols_raw = rel.columns
    d_cols = sorted(d_cols_raw)
    if s_cols != d_cols:
        return False, f"columns differ: spark={s_cols} duck={d_cols}"
    idx = [d_cols_raw.index(c) for c in d_cols]
    d_rows = [tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()]
    if len(s_rows) != len(d_rows):
        return False, f"rows differ: spark={len(s_rows)} duck={len(d_rows)}"
    cs, cd = Counter(s_rows), Counter(d_rows)
    if cs != cd:
        only_s = list((cs - cd).elements())[:2]
        only_d = list((cd - cs).elements())[:2]
        return False, f"values differ: spark-only={str(only_s)[:600]} duck-only={str(only_d)[:600]}"
    return True, f"{len(s_rows)} rows"
