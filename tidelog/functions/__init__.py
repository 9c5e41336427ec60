"""Column functions: natural key order, key ranges, filter sizing, isolation names, record frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISOLATION = ("READ_UNCOMMITTED", "READ_COMMITTED", "REPEATABLE_READ", "SNAPSHOT_ISOLATION", "SERIALIZABLE")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nkey(key: Column | str) -> Column:
    """Sort form of a key: digit runs padded, so that key_2 < key_10 (F1). Break ties by ``length(key)``."""
    runs = F.regexp_extract_all(_c(key), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike("^[0-9]"), F.lpad(x, 20, "0")).otherwise(x)), "")


def natural_order(key: Column | str = "key", descending: bool = False) -> list[Column]:
    cols = [nkey(key), F.length(_c(key)), _c(key)]
    return [c.desc() if descending else c.asc() for c in cols]


def key_successor(key: Column | str) -> Column:
    """The key with its last character raised by one (F6); empty stays empty."""
    k = _c(key)
    n = F.length(k)
    return F.when(n == 0, k).otherwise(F.concat(F.substring(k, F.lit(1), n - 1), F.chr(F.ascii(F.substring(k, n, F.lit(1))) + 1)))


def bloom_bits(n: Column | str, p: float) -> Column:
    """Bits for n keys at false-positive rate p, 64 at least."""
    return F.greatest(F.lit(64), F.floor(-_c(n) * F.log(F.lit(p)) / (F.log(F.lit(2.0)) * F.log(F.lit(2.0))))).cast("long")


def bloom_hashes(bits: Column, n: Column | str) -> Column:
    """Number of hash functions, 1 to 32."""
    return F.greatest(F.lit(1), F.least(F.lit(32), F.floor(bits / _c(n) * F.log(F.lit(2.0))))).cast("int")


def bloom_positions(key: Column | str, bits: int, hashes: int) -> Column:
    """Positions of a key by double hashing (F3, in 64-bit xxhash)."""
    k = _c(key)
    a, b = F.pmod(F.xxhash64(k), F.lit(bits)), F.pmod(F.xxhash64(k, F.lit(1)), F.lit(bits))
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(a + i * b, F.lit(bits)))


def isolation_name(level: Column | str) -> Column:
    """Name of a level number; unknown means snapshot isolation."""
    return F.coalesce(F.get(F.array(*[F.lit(x) for x in ISOLATION]), _c(level)), F.lit(ISOLATION[3]))


def isolation_level(name: Column | str) -> Column:
    """Number of a level given by name or by digit; unknown means 3."""
    out = F.lit(3)
    for i, x in enumerate(ISOLATION):
        out = F.when((F.upper(_c(name)) == x) | (_c(name) == str(i)), i).otherwise(out)
    return out


def isolation_description(level: Column | str) -> Column:
    texts = ("may see uncommitted data", "sees committed data only", "repeats reads within a transaction", "reads one snapshot", "behaves as if serial")
    return F.coalesce(F.get(F.array(*[F.lit(x) for x in texts]), _c(level)), F.lit(texts[3]))


def ratio(part: Column | str, whole: Column | str) -> Column:
    """part / whole, 0 where there is nothing."""
    return F.when(_c(whole) == 0, F.lit(0.0)).otherwise(_c(part) / _c(whole))


def record_bytes(key: Column | str, value: Column | str, deleted: Column | str) -> Column:
    """Bytes counted for a write: key and value, the key alone for a tombstone (A3)."""
    return (F.octet_length(_c(key)) + F.when(_c(deleted), 0).otherwise(F.coalesce(F.octet_length(_c(value)), F.lit(0)))).cast("long")


def frame_body(op: Column | str, key: Column | str, value: Column | str) -> Column:
    """Log record without its checksum: type, two little-endian lengths, key, value."""
    def le(n: Column) -> Column:
        return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(n, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(4)]))

    k, v = F.encode(_c(key), "UTF-8"), F.encode(_c(value), "UTF-8")
    return F.concat(F.unhex(F.lpad(F.hex(_c(op).cast("int")), 2, "0")), le(F.octet_length(k)), le(F.octet_length(v)), k, v)


def frame_crc(op: Column | str, key: Column | str, value: Column | str) -> Column:
    return F.crc32(frame_body(op, key, value))


def split_pair(text: Column | str) -> tuple[Column, Column]:
    """Key and value of ``key:value``, cut at the last colon-free suffix so that keys may hold colons."""
    t = _c(text)
    return F.regexp_extract(t, r"(?s)^(.*):([^:]*)$", 1), F.regexp_extract(t, r"(?s)^(.*):([^:]*)$", 2)
