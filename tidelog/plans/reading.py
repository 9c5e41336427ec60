"""Queries of the read operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ISOLATION, bloom_bits, bloom_hashes, isolation_level, isolation_name, natural_order
from ..operators import reads
from .registry import query
from .relations import Relations, nk


@query("SELECT key, version, value FROM live WHERE key = 'user:7'")
def point_get(r: Relations) -> DataFrame:
    return reads.get(r.kv, "user:7")


@query("SELECT key, version, value FROM live_half")
def snapshot_get(r: Relations) -> DataFrame:
    return reads.latest(r.kv, r.half)


WANTED = ("user:3", "user:999999", "user:10", "user:3", "user:1")
_wanted = ", ".join(f"({i}, '{k}')" for i, k in enumerate(WANTED))


def _multi(r: Relations) -> DataFrame:
    return reads.multi_get(r.kv, r.spark.createDataFrame(list(enumerate(WANTED)), "ordinal int, key string"))


@query(f"SELECT ordinal, w.key, value, version, version IS NOT NULL AS found FROM (VALUES {_wanted}) w(ordinal, key) LEFT JOIN live USING (key)")
def multi_get(r: Relations) -> DataFrame:
    return _multi(r)


@query(f"SELECT count(*) AS requested, count(version) AS found_count FROM (VALUES {_wanted}) w(ordinal, key) LEFT JOIN live USING (key)")
def multi_get_found_count(r: Relations) -> DataFrame:
    return _multi(r).agg(F.count(F.lit(1)).alias("requested"), F.count_if("found").alias("found_count"))


def _range(a: str, b: str, source: str = "live") -> str:
    return f"SELECT key, version, value FROM {source} WHERE {nk('key')} BETWEEN {nk(repr(a))} AND {nk(repr(b))}"


@query(_range("user:5", "user:15", "live_half"))
def range_scan(r: Relations) -> DataFrame:
    return reads.range_scan(r.kv, "user:5", "user:15", r.half)


@query("SELECT key, version, value FROM live WHERE starts_with(key, 'user:1')")
def prefix_scan(r: Relations) -> DataFrame:
    return reads.prefix_scan(r.kv, "user:1")


@query(_range("user:1", "user:2"))
def prefix_range_literal(r: Relations) -> DataFrame:
    return reads.prefix_range_literal(r.kv, "user:1")


@query(_range("user:1", "user:1z"))
def prefix_range_z(r: Relations) -> DataFrame:
    """The range from the prefix to the prefix and a z."""
    return reads.range_scan(r.kv, "user:1", "user:1z")


_paged = f"SELECT key, CAST((row_number() OVER (ORDER BY {nk('key')}, length(key), key) - 1) // 10 AS BIGINT) AS page, row_number() OVER (ORDER BY {nk('key')}, length(key), key) AS n, count(*) OVER () AS total FROM live"


@query(f"SELECT key, page FROM ({_paged})")
def paginate_pages(r: Relations) -> DataFrame:
    return reads.pages(r.kv, "", "~", 10).select("key", "page")


@query(f"SELECT page, max(CASE WHEN n = page * 10 + 1 THEN key END) AS token, bool_or(total > page * 10 + 10) AS has_more FROM ({_paged}) GROUP BY 1")
def page_tokens(r: Relations) -> DataFrame:
    n = reads.ranked(reads.latest(reads.between(r.kv, "", "~")), natural_order(), "n").withColumn("page", F.floor((F.col("n") - 1) / 10).cast("long"))
    # a page of the token tells of the page before it, so has_more needs no order among pages
    ends = n.select("key", F.col("page").alias("p"), (F.col("n") % 10 == 1).alias("first")).where("first")
    marks = ends.select(F.explode(F.array(F.struct(F.col("p").alias("page"), F.col("key").alias("token")), F.struct((F.col("p") - 1).alias("page"), F.lit(None).cast("string").alias("token")))).alias("m"))
    return marks.where("m.page >= 0").groupBy("m.page").agg(F.max("m.token").alias("token"), F.bool_or(F.col("m.token").isNull()).alias("has_more"))


@query("SELECT key FROM live")
def all_keys(r: Relations) -> DataFrame:
    """Visible keys in byte order."""
    return reads.latest(r.kv).select("key").orderBy("key")


@query(f"SELECT key, row_number() OVER (ORDER BY {nk('key')}, length(key), key) AS rank FROM live")
def natural_sort_rank(r: Relations) -> DataFrame:
    return reads.ranked(reads.latest(r.kv).select("key"), natural_order(), "rank")


@query(f"SELECT key, version, value FROM live ORDER BY {nk('key')}, length(key), key LIMIT 7")
def scan_limit(r: Relations) -> DataFrame:
    """O3."""
    return reads.latest(r.kv).orderBy(*natural_order()).limit(7)


@query(f"SELECT key, version, value FROM live WHERE {nk('key')} >= {nk(repr('user:12x'))} ORDER BY {nk('key')}, length(key), key LIMIT 1")
def seek_ge(r: Relations) -> DataFrame:
    return reads.seek(reads.latest(r.kv), "user:12x")


@query(f"SELECT key, lag(key) OVER (ORDER BY {nk('key')}, length(key), key) AS prev_key, lead(key) OVER (ORDER BY {nk('key')}, length(key), key) AS next_key FROM live")
def iter_neighbors(r: Relations) -> DataFrame:
    return reads.neighbors(reads.latest(r.kv)).select("key", "prev_key", "next_key")


@query(f"SELECT key, row_number() OVER (ORDER BY {nk('key')} DESC, length(key) DESC, key DESC) AS rank FROM live")
def reverse_scan(r: Relations) -> DataFrame:
    return reads.ranked(reads.latest(r.kv).select("key"), natural_order(descending=True), "rank")


@query("SELECT key, version, value, deleted FROM kv WHERE key = 'user:7'")
def version_history(r: Relations) -> DataFrame:
    return reads.history(r.kv, "user:7")


@query("SELECT key, array_to_string(list(version ORDER BY version DESC), ',') AS versions, count(*) AS n FROM kv GROUP BY key")
def version_chain(r: Relations) -> DataFrame:
    return reads.chains(r.kv).select("key", F.array_join(F.transform("chain", lambda x: x["version"].cast("string")), ",").alias("versions"), F.size("chain").cast("long").alias("n"))


@query("SELECT key, max(version) AS latest_version FROM kv_orders GROUP BY key")
def latest_version(r: Relations) -> DataFrame:
    return r.kv_orders.groupBy("key").agg(F.max("version").alias("latest_version"))


@query("SELECT key, version, lead(version) OVER (PARTITION BY key ORDER BY version) AS next_version FROM kv_orders")
def validity_intervals(r: Relations) -> DataFrame:
    return reads.validity(r.kv_orders).select("key", "version", "next_version")


_diff = "SELECT key, x.value AS old_value, y.value AS new_value, CASE WHEN x.key IS NULL THEN 'added' WHEN y.key IS NULL THEN 'removed' WHEN x.value <> y.value THEN 'changed' ELSE 'same' END AS change FROM live_half x FULL JOIN live y USING (key)"


@query(_diff)
def snapshot_diff(r: Relations) -> DataFrame:
    return reads.snapshot_diff(r.kv, r.half, r.n)


@query("SELECT key FROM live_half INTERSECT SELECT key FROM live")
def keys_in_both(r: Relations) -> DataFrame:
    return reads.latest(r.kv, r.half).select("key").intersect(reads.latest(r.kv).select("key"))


@query("SELECT key FROM live_half EXCEPT SELECT key FROM live")
def keys_removed(r: Relations) -> DataFrame:
    return reads.latest(r.kv, r.half).select("key").subtract(reads.latest(r.kv).select("key"))


@query("SELECT row_number() OVER (ORDER BY event_id) AS version, concat('user:', user_id) AS key, event_type AS value FROM events WHERE event_type <> 'view'")
def wal_replay(r: Relations) -> DataFrame:
    """Records renumbered in log order."""
    e = r.table("events").where("event_type <> 'view'").select("event_id", F.concat(F.lit("user:"), "user_id").alias("key"), F.col("event_type").alias("value"))
    return reads.numbered(e, "event_id", "version", 100_000).select("version", "key", "value")


_iso = ", ".join(f"('{a}', {n})" for a, n in [*((x, i) for i, x in enumerate(ISOLATION)), *((str(i), i) for i in range(5)), ("bogus", 3)])


_names = ", ".join(f"'{x}'" for x in ISOLATION)


@query(f"SELECT input, CAST(level AS INTEGER) AS level, [{_names}][level + 1] AS name FROM (VALUES {_iso}) t(input, level)")
def isolation_names(r: Relations) -> DataFrame:
    inputs = [*ISOLATION, *map(str, range(5)), "bogus"]
    d = r.spark.createDataFrame([(x,) for x in inputs], "input string")
    return d.select("input", isolation_level("input").cast("int").alias("level"), isolation_name(isolation_level("input")).alias("name"))


@query("""SELECT n, p, bits, CAST(greatest(1, least(32, floor(bits / n * ln(2.0)))) AS INTEGER) AS hashes FROM (
  SELECT n, p, CAST(greatest(64, floor(-n * ln(p) / (ln(2.0) * ln(2.0)))) AS BIGINT) AS bits FROM (SELECT count(*) AS n FROM kv GROUP BY key) a, (VALUES (0.01::DOUBLE), (0.001::DOUBLE)) b(p))""")
def bloom_sizing(r: Relations) -> DataFrame:
    n = r.kv.groupBy("key").count().select(F.col("count").alias("n"))
    out = None
    for p in (0.01, 0.001):
        one = n.select("n", F.lit(p).alias("p"), bloom_bits("n", p).alias("bits"))
        one = one.select("n", "p", "bits", bloom_hashes(F.col("bits"), "n").alias("hashes"))
        out = one if out is None else out.unionByName(one)
    return out

