"""Where queries and their SQL twins meet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .relations import PRELUDE, Relations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function of Relations under its name, with the SQL that follows PRELUDE."""

    def add(f: Callable[[Relations], DataFrame]) -> Callable[[Relations], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Relations(spark, sf_dir))
        if sql is not None:
            SQL[f.__name__] = PRELUDE + sql
        return f

    return add
