from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_cols(xs: Iterable[str | Column]) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]
