"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import ROWS_A_TASK, drop, scratch, stored

__all__ = ["ROWS_A_TASK", "ascii_lower", "drop", "let", "scratch", "stored", "table", "thinned"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and evaluate ``body`` on it (a lambda body would evaluate it per element)."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, UPPER.lower())


def thinned(hash_: Column, wanted: int, rows: int) -> Column:
    """A condition on a 64-bit hash that leaves about ``wanted`` of ``rows`` rows; all where there are no more.

    A bounded sample is then sorted out of a few rows, not out of the best of every task.
    """
    if rows <= wanted:
        return F.lit(True)
    return F.pmod(hash_, F.lit(1 << 40)) < F.lit(-(-(wanted << 40) // rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
