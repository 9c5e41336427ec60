"""Byte codecs of log files and sorted files (little-endian integers throughout)."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

LOG_MAGIC, LOG_VERSION, LOG_HEADER = 0xABCD1234, 1, 8
SST_MAGIC, SST_VERSION, SST_HEADER = 0xABCD5678, 3, 40
PUT, DELETE = 1, 2
TOMBSTONE = b"__DELETED__"
MAX_RECORD = 1 << 20


def log_record(op: int, key: bytes, value: bytes) -> bytes:
    body = struct.pack("<BII", op, len(key), len(value)) + key + value
    return struct.pack("<I", zlib.crc32(body)) + body


def write_log(records: Iterable[tuple[int, bytes, bytes]]) -> bytes:
    return struct.pack("<II", LOG_MAGIC, LOG_VERSION) + b"".join(log_record(*r) for r in records)


def read_log(data: bytes) -> Iterator[tuple[int, int, int, bytes, bytes, bool]]:
    """(offset, crc, op, key, value, crc_ok) of every framed record.

    A record whose checksum fails is flagged and the frame after it is read; a frame that runs past
    the end of the file, as a torn last write leaves it, ends the log.
    """
    if len(data) < LOG_HEADER or struct.unpack_from("<I", data)[0] != LOG_MAGIC:
        return
    at = LOG_HEADER
    while at + 13 <= len(data):
        crc, op, k, v = struct.unpack_from("<IBII", data, at)
        end = at + 13 + k + v
        if end > len(data):
            return
        body = data[at + 4 : end]
        yield at, crc, op, body[9 : 9 + k], body[9 + k :], zlib.crc32(body) == crc
        at = end


def write_sorted(rows: Iterable[tuple[bytes, bytes]]) -> bytes:
    out = [b""]
    for key, value in rows:
        if not key:
            raise ValueError("keys are not empty")
        n = 8 + len(key) + len(value)
        if n > MAX_RECORD:
            raise ValueError("record larger than 1 MiB")
        out.append(struct.pack("<II", n, len(key)) + key + struct.pack("<I", len(value)) + value)
    out[0] = struct.pack("<IIQQ4I", SST_MAGIC, SST_VERSION, 0, SST_HEADER, 0, 0, 0, 0)
    return b"".join(out)


def read_sorted(data: bytes) -> Iterator[tuple[int, bytes, bytes, bool]]:
    """(offset, key, value, tombstone); stops at the filter block or at a record that cannot be."""
    if len(data) < SST_HEADER:
        return
    magic, _, bloom, at = struct.unpack_from("<IIQQ", data)
    if magic != SST_MAGIC:
        return
    end = bloom if bloom > at else len(data)
    while at + 12 <= end:
        n, k = struct.unpack_from("<II", data, at)
        if not 0 < n <= MAX_RECORD or not 0 < k <= n - 8 or at + 4 + n > end:
            return
        key = data[at + 8 : at + 8 + k]
        (v,) = struct.unpack_from("<I", data, at + 8 + k)
        value = data[at + 12 + k : at + 12 + k + v]
        yield at, key, value, value == TOMBSTONE
        at += 4 + n
