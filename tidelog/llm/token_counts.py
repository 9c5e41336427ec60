"""Token counts from an exact length histogram.

Documents are aggregated by encoded length. Suffix sums over the histogram answer, for every context
limit, how many documents and tokens there are, quantiles, and the total after truncation, without
another pass over the texts.

Defined results: null text counts as empty (length 0); repeated rows count each; an empty table gives
an empty histogram; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tokens import default_path, encoder

WIDE = 64


def lengths(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """(length): the encoded length of every row."""
    path = path or default_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(path).ids
        for b in batches:
            yield pa.record_batch([pa.array([len(ids(t.as_py() or "")) for t in b.column(0)], pa.int64())], ["length"])

    return docs.select(F.col(text).cast("string").alias("t")).mapInArrow(count, "length long")


def histogram(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """(length, n_docs): combined in each task before the shuffle."""
    return lengths(docs, text, path).groupBy("length").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """Per length L: documents and tokens at most L, documents and tokens beyond it, and the total truncated to L.

    Sums run in ranges of WIDE lengths and then over the ranges' totals, so no task holds all lengths.
    """
    h = hist.withColumn("r", F.expr(f"length div {WIDE}"))
    inner = Window.partitionBy("r").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    h = h.select("*", F.sum("n_docs").over(inner).alias("d"), F.sum(F.col("n_docs") * F.col("length")).over(inner).alias("t"))
    ranges = hist.groupBy(F.expr(f"length div {WIDE}").alias("r")).agg(F.sum("n_docs").alias("rd"), F.sum(F.col("n_docs") * F.col("length")).alias("rt"))
    before, all_ = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("r").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0)
    ranges = ranges.select(
        "r", F.coalesce(F.sum("rd").over(before), zero).alias("bd"), F.coalesce(F.sum("rt").over(before), zero).alias("bt"),
        F.sum("rd").over(all_).alias("ad"), F.sum("rt").over(all_).alias("at"),
    )
    j = h.join(ranges, "r")
    le, lt = F.col("bd") + F.col("d"), F.col("bt") + F.col("t")
    return j.select(
        "length", "n_docs", (F.col("n_docs") * F.col("length")).alias("n_tokens"),
        le.alias("docs_le"), lt.alias("tokens_le"), (F.col("ad") - le).alias("docs_gt"), (F.col("at") - lt).alias("tokens_gt"),
        (lt + (F.col("ad") - le) * F.col("length")).alias("truncated_total"),
        (le / F.col("ad")).alias("quantile"),
    )


def totals(hist: DataFrame, limits: list[int]) -> DataFrame:
    """For each limit: documents and tokens at most it, documents beyond it and the truncated total."""
    spark = hist.sparkSession
    lim = spark.createDataFrame([(int(x),) for x in sorted(set(limits))], "limit long")
    one = hist.select(F.explode(F.array(*[F.lit(int(x)).cast("long") for x in sorted(set(limits))])).alias("limit"), "length", "n_docs")
    got = one.groupBy("limit").agg(
        F.sum(F.when(F.col("length") <= F.col("limit"), F.col("n_docs")).otherwise(0)).alias("docs_le"),
        F.sum(F.when(F.col("length") <= F.col("limit"), F.col("n_docs") * F.col("length")).otherwise(0)).alias("tokens_le"),
        F.sum(F.when(F.col("length") > F.col("limit"), F.col("n_docs")).otherwise(0)).alias("docs_gt"),
        F.sum(F.least("length", "limit") * F.col("n_docs")).alias("truncated_total"),
    )
    return lim.join(got, "limit", "left").na.fill(0)


def quantile(hist: DataFrame, q: float) -> DataFrame:
    """(length): the smallest length with at least the fraction q of documents at most as long; no row if empty."""
    return suffix_sums(hist).where((F.col("quantile") >= q)).agg(F.min("length").alias("length")).where("length is not null")
