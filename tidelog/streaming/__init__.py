"""Structured Streaming over an append-only version log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reads import newest
from ..scratch import scratch


def versions(events: DataFrame) -> DataFrame:
    return events.select(F.concat(F.lit("user:"), "user_id").alias("key"), (F.col("event_id") + 1).alias("version"), F.col("event_type").alias("value"), (F.col("event_type") == "error").alias("deleted"))


def upsert_batches(stream: DataFrame, path: str, checkpoint: str, **trigger):
    """Fold each micro-batch to its newest versions and append them as one folder per batch.

    A repeated batch overwrites its own folder, so the sink is idempotent; order never matters,
    because readers fold by the largest version again.
    """

    def write(batch: DataFrame, number: int) -> None:
        newest(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def replay_latest(spark: SparkSession, path: str) -> DataFrame:
    """Read a log file or folder as a stream until its end; newest version per key, tombstones included."""
    out = scratch(spark, "stream")
    schema = spark.read.parquet(path).schema
    head, _, name = path.rstrip("/").rpartition("/")
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    one = name.endswith(".parquet") and "part-" not in name
    stream = source.parquet(f"{head}/{name}" if not one else f"{head}/{name}*")
    upsert_batches(versions(stream), f"{out}/data", f"{out}/state").awaitTermination()
    return newest(spark.read.parquet(f"{out}/data").drop("batch"))


def window_counts(stream: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Writes per key and event-time window; rows later than the watermark are left out."""
    t = stream.withColumn("at", F.col("ts").cast("timestamp"))
    return t.withWatermark("at", late).groupBy(F.window("at", size), F.col("user_id")).agg(F.count(F.lit(1)).alias("writes"))
