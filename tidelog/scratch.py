"""Intermediate tables in the shared folder named by ``spark.checkpoint.dir``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_SCRATCH = "/tmp/checkpoints"
#: Rows a task writes where the caller knows how many there are.
ROWS_A_TASK = 250_000


def shared_folder(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names; a local one where it is unset and the session has one machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = LOCAL_SCRATCH
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/tidelog/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, rows: int | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: lineage is cut, lost executors cost nothing.

    With ``rows``, about how many there are at most, as few tasks write as these need.
    """
    path = scratch(df.sparkSession, name)
    (df if rows is None else df.coalesce(-(-rows // ROWS_A_TASK) or 1)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        h = jvm.org.apache.hadoop.fs.Path(p)
        h.getFileSystem(conf).delete(h, True)
