"""The single source of randomness.

``h(seed, k1, k2, ...)`` is the first 32 bits of ``md5('seed|k1|k2|...')`` as a non-negative BIGINT.
It is a pure function of its inputs, so a re-run (or a retried task) draws the same numbers, and the
SQL oracle replays it as ``('0x' || substr(md5(concat_ws('|', ...)), 1, 8))::BIGINT``.
Shuffles are ``ORDER BY h, key``; uniform picks in ``[0, n)`` are ``h % n``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 32


def _as_col(x) -> Column:
    if isinstance(x, Column):
        return x.cast("string")
    return F.lit(str(x))


def h(seed, *parts) -> Column:
    """Deterministic 32-bit draw from ``seed`` and key parts (Columns or literals)."""
    s = F.concat_ws("|", _as_col(seed), *[_as_col(p) for p in parts])
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint")


def h60(seed, *parts) -> Column:
    """As :func:`h` with 60 bits, for uniform picks from spaces of any size: ``h60 % n``."""
    s = F.concat_ws("|", _as_col(seed), *[_as_col(p) for p in parts])
    return F.conv(F.substring(F.md5(s), 1, 15), 16, 10).cast("bigint")


def sql_h60(seed, *parts: str) -> str:
    """DuckDB replay of :func:`h60`."""
    inner = ", ".join([f"'{seed}'"] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return f"('0x' || substr(md5(concat_ws('|', {inner})), 1, 15))::BIGINT"


def sql_h(seed, *parts: str) -> str:
    """DuckDB replay of :func:`h`; ``parts`` are SQL expressions, ``seed`` a literal."""
    inner = ", ".join([f"'{seed}'"] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return f"('0x' || substr(md5(concat_ws('|', {inner})), 1, 8))::BIGINT"


def spark_sql_h(seed, *parts: str) -> str:
    """Spark SQL text of :func:`h` for ``selectExpr`` / ``F.expr`` use."""
    inner = ", ".join([f"'{seed}'"] + [f"CAST({p} AS STRING)" for p in parts])
    return f"CAST(conv(substr(md5(concat_ws('|', {inner})), 1, 8), 16, 10) AS BIGINT)"
