"""``spark.read.format("kvwal" | "kvsst")`` and the matching batch writers.

One file is one partition on read; each task writes one file, published by a rename on commit, so a
retried task leaves nothing behind. Paths are folders or files that every executor sees.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from . import codec


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Done(WriterCommitMessage):
    def __init__(self, path: str):
        self.path = path


def _files(path: str, suffix: str) -> list[str]:
    path = path.removeprefix("file://")
    if os.path.isdir(path):
        return sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith(suffix))
    return [path]


class _Reader(DataSourceReader):
    def __init__(self, options: dict, suffix: str):
        self.files, self.suffix = _files(options["path"], suffix), suffix

    def partitions(self):
        return [_File(f) for f in self.files]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            data = f.read()
        text = lambda b: b.decode("utf-8", "replace")
        if self.suffix == ".wal":
            for at, crc, op, key, value, ok in codec.read_log(data):
                yield partition.path, at, crc, op, text(key), text(value), ok
        else:
            for at, key, value, dead in codec.read_sorted(data):
                yield partition.path, at, text(key), None if dead else text(value), dead


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, suffix: str, names: list[str], overwrite: bool):
        self.path, self.suffix, self.names, self.overwrite = options["path"].removeprefix("file://"), suffix, names, overwrite

    def write(self, rows: Iterator) -> _Done:
        os.makedirs(self.path, exist_ok=True)
        raw = lambda v: (v or "").encode()
        if self.suffix == ".wal":
            data = codec.write_log((r["op"], raw(r["key"]), raw(r["value"])) for r in rows)
        else:
            data = codec.write_sorted((raw(r["key"]), codec.TOMBSTONE if r["deleted"] else raw(r["value"])) for r in rows)
        name = os.path.join(self.path, f".{uuid.uuid4().hex}.tmp")
        with open(name, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        return _Done(name)

    def commit(self, messages) -> None:
        old = _files(self.path, self.suffix) if self.overwrite and os.path.isdir(self.path) else []
        for i, m in enumerate(messages):
            if m is not None:
                os.rename(m.path, os.path.join(self.path, f"{i:05d}-{uuid.uuid4().hex[:8]}{self.suffix}"))
        for f in old:
            os.remove(f)

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


class LogSource(DataSource):
    """Log files: (file, offset, crc, op, key, value, crc_ok)."""

    @classmethod
    def name(cls) -> str:
        return "kvwal"

    def schema(self) -> str:
        return "file string, offset long, crc long, op int, key string, value string, crc_ok boolean"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, ".wal")

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, ".wal", schema.names, overwrite)


class SortedSource(DataSource):
    """Sorted files: (file, offset, key, value, deleted)."""

    @classmethod
    def name(cls) -> str:
        return "kvsst"

    def schema(self) -> str:
        return "file string, offset long, key string, value string, deleted boolean"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, ".sst")

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, ".sst", schema.names, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogSource)
    spark.dataSource.register(SortedSource)
