"""Queries of tiers, segments, compaction, collection, filters and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import frame_body, frame_crc, nkey
from ..operators import storage as st
from ..operators.reads import newest
from .registry import query
from .relations import Relations, nk


@query("SELECT key, version, value, tier FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY tier, version DESC) AS r FROM tiers) WHERE r = 1 AND NOT deleted")
def merge_on_read(r: Relations) -> DataFrame:
    return st.merge_on_read(r.tiers).select("key", "version", "value", F.col("tier").cast("int").alias("tier"))


@query("SELECT segment_id, min_key, max_key, min_version, max_version, rows, bytes FROM man")
def file_manifest(r: Relations) -> DataFrame:
    return r.segments


@query(f"SELECT segment_id, rows FROM man WHERE {nk('min_key')} <= {nk(repr('user:9'))} AND {nk('max_key')} >= {nk(repr('user:5'))}")
def files_touched(r: Relations) -> DataFrame:
    return st.files_touched(r.segments, "user:5", "user:9").select("segment_id", "rows")


@query(f"SELECT segment_id, min_version FROM man WHERE {nk('min_key')} <= {nk(repr('user:7'))} AND {nk('max_key')} >= {nk(repr('user:7'))} AND min_version <= (SELECT half FROM c)")
def version_prune(r: Relations) -> DataFrame:
    return st.files_touched(r.segments, "user:7", "user:7", r.half).select("segment_id", "min_version")


@query("SELECT count(*) AS num_keys, count(*) FILTER (NOT deleted) AS active, count(*) FILTER (deleted) AS tombstones FROM newest")
def tombstone_summary(r: Relations) -> DataFrame:
    return newest(r.kv).agg(F.count(F.lit(1)).alias("num_keys"), F.count_if(~F.col("deleted")).alias("active"), F.count_if("deleted").alias("tombstones"))


@query("SELECT count(DISTINCT key) AS num_keys, count(*) AS num_versions, max(version) AS current_version, CAST(sum(b) AS BIGINT) AS num_bytes FROM seg")
def store_stats(r: Relations) -> DataFrame:
    b = st.record_bytes("key", "value", "deleted")
    per = r.kv.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("version").alias("v"), F.sum(b).alias("b"))
    return per.agg(F.count(F.lit(1)).alias("num_keys"), F.sum("n").alias("num_versions"), F.max("v").alias("current_version"), F.sum("b").alias("num_bytes"))


@query("""SELECT CAST(coalesce(tier, -1) AS INTEGER) AS tier, CAST(sum(k) AS BIGINT) AS num_keys, CAST(sum(n) AS BIGINT) AS num_versions, CAST(sum(b) AS BIGINT) AS num_bytes FROM (
  SELECT tier, count(DISTINCT key) AS k, count(*) AS n, sum(strlen(key) + CASE WHEN deleted THEN 0 ELSE strlen(value) END) AS b FROM tiers GROUP BY 1) GROUP BY ROLLUP (tier)""")
def tier_stats(r: Relations) -> DataFrame:
    return st.tier_stats(r.tiers)


def _snapshots(r: Relations) -> DataFrame:
    return r.kv.where("version % 1000 = 0").select(F.floor(F.col("version") / 1000).alias("snapshot_id"), "version", (F.col("version") % 3000 == 0).alias("released"))


@query("SELECT least((SELECT n FROM c), min(version)) AS horizon FROM kv WHERE version % 1000 = 0 AND version % 3000 <> 0")
def gc_horizon(r: Relations) -> DataFrame:
    return st.gc_horizon(r.kv, _snapshots(r))


_safe = "SELECT key, version, value, deleted FROM kv WHERE version > (SELECT half FROM c) UNION ALL SELECT key, version, value, deleted FROM newest_half WHERE NOT deleted"


@query(_safe)
def gc_safe(r: Relations) -> DataFrame:
    return st.gc_safe(r.kv, r.half)


@query("SELECT key, version, value, deleted FROM kv WHERE version >= (SELECT half FROM c)")
def gc_threshold_literal(r: Relations) -> DataFrame:
    return st.gc_threshold_literal(r.kv, r.half)


@query(f"SELECT (SELECT count(*) FROM kv) AS versions_before, (SELECT count(DISTINCT key) FROM kv) AS keys_before, count(*) AS versions_after, count(DISTINCT key) AS keys_after FROM ({_safe})")
def gc_stats(r: Relations) -> DataFrame:
    """Before and after in one pass: what survives is told by the newest old version of each key."""
    h = F.lit(r.half)
    old = F.max(F.when(F.col("version") <= h, F.struct("version", "deleted")))
    g = r.kv.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("version") > h).alias("new"), F.coalesce((~old["deleted"]).cast("int"), F.lit(0)).alias("base"))
    left = F.col("new") + F.col("base")
    return g.agg(F.sum("n").alias("versions_before"), F.count(F.lit(1)).alias("keys_before"), F.sum(left).alias("versions_after"), F.count_if(left > 0).alias("keys_after"))


@query("SELECT key, count(*) AS versions FROM kv_orders GROUP BY key HAVING count(*) > 15")
def hot_keys(r: Relations) -> DataFrame:
    """A7."""
    return r.kv_orders.groupBy("key").agg(F.count(F.lit(1)).alias("versions")).where("versions > 15")


@query("SELECT count(*) AS versions, count(*) > 10000 AS over_total, coalesce((SELECT max(n) FROM (SELECT count(*) AS n FROM kv_orders GROUP BY key)), 0) > 10 AS over_per_key FROM kv_orders")
def gc_trigger(r: Relations) -> DataFrame:
    """A8, M5."""
    per = r.kv_orders.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("versions"), (F.coalesce(F.sum("n"), F.lit(0)) > 10_000).alias("over_total"), (F.coalesce(F.max("n"), F.lit(0)) > 10).alias("over_per_key"))


@query("SELECT key, version, value, deleted FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY version DESC) AS r FROM kv) WHERE r <= 5")
def keep_n_versions(r: Relations) -> DataFrame:
    return st.keep_n_versions(r.kv, 5)


@query("""SELECT key, version, CAST(coalesce(sum(b) OVER (ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 4096 AS BIGINT) AS segment_id FROM seg""")
def flush_segments(r: Relations) -> DataFrame:
    return st.flush_segments(r.kv, 4096, 10_000).select("key", "version", "segment_id")


@query("SELECT level, count(*) AS files, CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(bytes) AS BIGINT) AS bytes FROM lev GROUP BY 1")
def level_sizes(r: Relations) -> DataFrame:
    return r.levels.groupBy("level").agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))


@query("""SELECT level, files, bytes, size_limit, CASE WHEN level = 0 THEN files ELSE bytes END >= size_limit AS triggered FROM (
  SELECT level, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(CASE WHEN level = 0 THEN 8 ELSE 20000 * pow(10.0, greatest(level - 1, 0)) END AS BIGINT) AS size_limit FROM lev GROUP BY 1)""")
def compaction_trigger(r: Relations) -> DataFrame:
    return st.compaction_trigger(r.levels, 8, 20_000)


@query("SELECT level, segment_id, bytes FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY bytes DESC, segment_id) AS r FROM lev WHERE level > 0) WHERE r = 1")
def compaction_pick(r: Relations) -> DataFrame:
    """The largest segment of each level below the first."""
    m = F.min(F.struct((-F.col("bytes")).alias("b"), "segment_id")).alias("m")
    return r.levels.where("level > 0").groupBy("level").agg(m).select("level", F.col("m.segment_id").alias("segment_id"), (-F.col("m.b")).alias("bytes"))


@query(f"SELECT a.segment_id, b.segment_id AS lower_id FROM lev a JOIN lev b ON b.level = a.level + 1 AND {nk('a.min_key')} <= {nk('b.max_key')} AND {nk('b.min_key')} <= {nk('a.max_key')}")
def compaction_pick_overlap(r: Relations) -> DataFrame:
    """Segments of the next level that a segment's key range overlaps (equi-join on the level)."""
    a = r.levels.select("segment_id", "level", nkey("min_key").alias("lo"), nkey("max_key").alias("hi"))
    b = a.select(F.col("segment_id").alias("lower_id"), (F.col("level") - 1).alias("level"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    return a.join(b, "level").where("lo <= hi2 and lo2 <= hi").select("segment_id", "lower_id")


@query("""SELECT key, version, value, deleted FROM kv WHERE version <= (SELECT n FROM c) // 4 * 3 AND version > (SELECT half FROM c)
UNION ALL SELECT key, version, value, deleted FROM newest_half""")
def compaction_output(r: Relations) -> DataFrame:
    return st.compaction_output(r.kv.where(F.col("version") <= r.n // 4 * 3), r.half, bottom=False)


@query("SELECT key, version, value, deleted FROM newest WHERE NOT deleted")
def full_compaction(r: Relations) -> DataFrame:
    """M3 at the bottom with nothing to keep: the newest live versions."""
    return st.compaction_output(r.kv, r.n, bottom=True)


_batch = "SELECT row_number() OVER (ORDER BY event_id) AS ordinal, concat('user:', user_id) AS key, event_type AS value FROM events WHERE event_type {}"


def _batch_df(r: Relations, cond: str, op: str) -> DataFrame:
    return r.table("events").where(f"event_type {cond}").select(F.col("event_id").alias("ordinal"), F.lit(op).alias("op"), F.concat(F.lit("user:"), "user_id").alias("key"), F.col("event_type").alias("value"))


@query(f"SELECT key, ordinal + (SELECT n FROM c) AS version, value, false AS deleted FROM ({_batch.format(chr(61) + ' ' + repr('purchase'))})")
def apply_puts(r: Relations) -> DataFrame:
    return st.apply_batch(_batch_df(r, "= 'purchase'", "put"), r.n)


@query(f"SELECT key, ordinal + (SELECT n FROM c) AS version, CAST(NULL AS VARCHAR) AS value, true AS deleted FROM ({_batch.format(chr(61) + ' ' + repr('signup'))})")
def apply_deletes(r: Relations) -> DataFrame:
    return st.apply_batch(_batch_df(r, "= 'signup'", "del"), r.n)


@query(f"SELECT key, max(ordinal) + (SELECT n FROM c) AS version, arg_max(value, ordinal) AS value FROM ({_batch.format('IN ' + repr(('purchase', 'view')))}) GROUP BY 1")
def batch_write(r: Relations) -> DataFrame:
    """A batch as seen afterwards: the later operation on a key wins."""
    b = st.apply_batch(_batch_df(r, "in ('purchase', 'view')", "put"), r.n)
    return newest(b).select("key", "version", "value")


_sim = """SELECT a.seq, a.key, a.prev IS NOT NULL AND (SELECT count(DISTINCT b.user_id) FROM e b WHERE b.event_id > a.prev AND b.event_id < a.seq) < 40 AS hit FROM (
  SELECT event_id AS seq, user_id AS key, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM e) a"""
_e = ", e AS (SELECT event_id, user_id FROM events)\n"


def _access(r: Relations) -> DataFrame:
    return r.table("events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"))


@query(_e + _sim)
def cache_sim(r: Relations) -> DataFrame:
    """W5 over all accesses."""
    return st.cache_sim(_access(r), 40)


@query(_e + f"SELECT count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, CASE WHEN count(*) = 0 THEN 0.0 ELSE count(*) FILTER (hit) / count(*) END AS hit_rate FROM ({_sim})")
def cache_hit_rate(r: Relations) -> DataFrame:
    return st.hit_rate(st.cache_sim(_access(r), 40))


@query()
def bloom_no_false_negatives(r: Relations) -> DataFrame:
    """M8: members and strangers with their answers; every member must be a maybe."""
    keys = r.kv.select("key").distinct()
    bits, k = 1 << 16, 6
    probes = keys.withColumn("member", F.lit(True)).unionByName(keys.select(F.concat("key", F.lit("-absent")).alias("key"), F.lit(False).alias("member")))
    return st.may_contain(probes, st.bloom(keys, bits, k), bits, k)


@query()
def wal_frame(r: Relations) -> DataFrame:
    """Checksum and length of each record."""
    op = F.when(F.col("deleted"), 2).otherwise(1)
    v = F.when(F.col("deleted"), "").otherwise(F.col("value"))
    return r.kv.select("version", frame_crc(op, "key", v).alias("crc"), (F.octet_length(frame_body(op, F.col("key"), v)) + 4).cast("long").alias("length"))


@query()
def wal_summary(r: Relations) -> DataFrame:
    """Records by type and checksum state; every 97th record is read back with a changed value."""
    op = F.when(F.col("deleted"), 2).otherwise(1)
    v = F.when(F.col("deleted"), "").otherwise(F.col("value"))
    back = F.when(F.col("version") % 97 == 0, F.concat(v, F.lit("!"))).otherwise(v)
    rec = r.kv.select(op.alias("op"), (frame_crc(op, "key", v) == frame_crc(op, "key", back)).alias("crc_ok"))
    return rec.groupBy("op", "crc_ok").agg(F.count(F.lit(1)).alias("records"))
