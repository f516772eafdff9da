"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Added before rounding on both sides, so that decimal ties do not lie on a rounding edge.
EDGE = 1.2345e-7

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) under a name, with the SQL that gives the same rows."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql.replace("round(", f"round({EDGE} + ")
        return f

    return add


def six(c: str | Column, places: int = 6) -> Column:
    """Rounded; NaN and infinities become null."""
    x = F.col(c) if isinstance(c, str) else c
    x = x.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(F.round(x + EDGE, places))


def shown(df: DataFrame, keys: list[str], values: list[str], places: int = 6) -> DataFrame:
    """Keys (dates as text, timestamps as seconds) and rounded values."""
    kinds = dict(df.dtypes)
    k = [F.col(c).cast("string").alias(c) if kinds[c] == "date" else F.unix_timestamp(c).alias(c) if kinds[c] == "timestamp" else F.col(c) for c in keys]
    return df.select(*k, *[six(c, places).alias(c) if kinds[c] == "double" else F.col(c).cast("long").alias(c) if kinds[c] in ("int", "boolean") else F.col(c) for c in values])
