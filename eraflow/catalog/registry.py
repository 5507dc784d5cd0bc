"""Registry of runnable queries: a name, a Spark callable and, where a plain SQL
engine can express the same thing on whole tables, the SQL of the same answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles so that the order of additions does not show; widen integers."""
    cells = []
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            cells.append((F.round(F.col(name).cast("double"), digits) + F.lit(0.0)).alias(name))
        elif kind in ("int", "smallint", "tinyint"):
            cells.append(F.col(name).cast("bigint").alias(name))
        else:
            cells.append(F.col(name))
    return df.select(*cells)
