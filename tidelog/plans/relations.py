"""Relations derived from the driver's tables, as DataFrames and as DuckDB common table expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import transactions as tx


class Relations:
    """Lazy views over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def kv(self) -> DataFrame:
        e = self.table("events")
        return e.select(F.concat(F.lit("user:"), "user_id").alias("key"), (F.col("event_id") + 1).alias("version"), F.col("event_type").alias("value"), (F.col("event_type") == "error").alias("deleted"))

    @cached_property
    def kv_orders(self) -> DataFrame:
        o = self.table("orders")
        return o.select(F.concat(F.lit("cust:"), "o_custkey").alias("key"), (F.col("o_orderkey") + 1).alias("version"), F.col("o_orderpriority").alias("value"), (F.col("o_orderstatus") == "P").alias("deleted"))

    @cached_property
    def n(self) -> int:
        """The newest version."""
        return self.kv.agg(F.max("version").alias("n")).first().n or 0

    @property
    def half(self) -> int:
        return self.n // 2

    @cached_property
    def tiers(self) -> DataFrame:
        v = F.col("version")
        return self.kv.withColumn("tier", F.when(v * 10 > self.n * 8, 0).when(v * 10 > self.n * 5, 1).otherwise(2))

    @cached_property
    def ops(self) -> DataFrame:
        i = F.col("event_id")
        e = F.col("event_type")
        return self.table("events").select(
            (F.floor(i / 16) * 4 + i % 4 + 1).alias("txn_id"), i.alias("seq"), F.concat(F.lit("acct:"), F.col("user_id") % 8).alias("key"),
            F.when(e.isin("view", "click"), "R").when(e == "error", "D").otherwise("W").alias("op"), e.alias("value"),
        )

    @cached_property
    def txns(self) -> DataFrame:
        g = self.ops.groupBy("txn_id").agg(F.min("seq").alias("begin_seq"), F.max("seq").alias("last_seq"))
        return g.select("txn_id", "begin_seq", "last_seq", (F.col("last_seq") + 1 + 4 * (F.col("txn_id") % 3)).alias("commit_seq"), (F.col("txn_id") % 5).cast("int").alias("lvl"))

    @cached_property
    def gaps(self) -> DataFrame:
        """Gap locks from the smallest to the largest account that a transaction touches."""
        return self.ops.groupBy("txn_id").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))

    @cached_property
    def acks(self) -> DataFrame:
        return self.table("events").groupBy(F.col("event_type").alias("node")).agg((F.max("event_id") + 1).alias("match_index"))

    @cached_property
    def votes(self) -> DataFrame:
        e = self.table("events")
        m = F.min(F.struct("event_id", "event_type")).alias("m")
        g = e.groupBy(F.floor(F.col("event_id") / 50).alias("term"), (F.col("user_id") % 5).alias("node")).agg(m)
        return g.select("term", "node", F.when(F.col("m.event_type").isin("view", "click", "signup"), "n1").otherwise("n2").alias("candidate"))

    @cached_property
    def leader(self) -> DataFrame:
        i = F.col("event_id")
        return self.table("events").select(
            (i + 1).alias("index"), (F.floor(i / 100) + 1).alias("term"), F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("command"),
            F.concat(F.lit("user:"), "user_id").alias("key"), F.col("event_type").alias("value"),
        )

    @cached_property
    def follower(self) -> DataFrame:
        """The leader's log up to 95 %, with a stale term in its last tenth."""
        x = F.col("index")
        cut = self.leader.where(x * 100 <= self.n * 95)
        return cut.withColumn("term", F.when(x * 100 > self.n * 90, F.col("term") - 1).otherwise(F.col("term")))

    @cached_property
    def locks(self) -> DataFrame:
        return tx.lock_modes(self.ops)

    @cached_property
    def segments(self) -> DataFrame:
        from ..operators.storage import manifest

        width = max(1, self.n // 20)
        return manifest(self.kv, F.floor((F.col("version") - 1) / width).cast("long"))

    @cached_property
    def levels(self) -> DataFrame:
        """The manifest with levels: newest segments in level 0."""
        s = F.col("segment_id")
        return self.segments.withColumn("level", F.when(s >= 12, 0).when(s >= 6, 1).otherwise(2))


NK = "array_to_string(list_transform(regexp_extract_all({k}, '([0-9]+|[^0-9]+)'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(x, 20, '0') ELSE x END), '')"


def nk(k: str) -> str:
    return NK.format(k=k)


PRELUDE = f"""WITH kv AS (SELECT concat('user:', user_id) AS key, event_id + 1 AS version, event_type AS value, event_type = 'error' AS deleted FROM events),
kv_orders AS (SELECT concat('cust:', o_custkey) AS key, o_orderkey + 1 AS version, o_orderpriority AS value, o_orderstatus = 'P' AS deleted FROM orders),
c AS (SELECT max(version) AS n, max(version) // 2 AS half FROM kv),
newest AS (SELECT key, max(version) AS version, arg_max(value, version) AS value, arg_max(deleted, version) AS deleted FROM kv GROUP BY 1),
live AS (SELECT key, version, value FROM newest WHERE NOT deleted),
newest_half AS (SELECT key, max(version) AS version, arg_max(value, version) AS value, arg_max(deleted, version) AS deleted FROM kv WHERE version <= (SELECT half FROM c) GROUP BY 1),
live_half AS (SELECT key, version, value FROM newest_half WHERE NOT deleted),
tiers AS (SELECT *, CASE WHEN version * 10 > (SELECT n FROM c) * 8 THEN 0 WHEN version * 10 > (SELECT n FROM c) * 5 THEN 1 ELSE 2 END AS tier FROM kv),
ops AS (SELECT CAST(event_id // 16 * 4 + event_id % 4 + 1 AS BIGINT) AS txn_id, event_id AS seq, concat('acct:', user_id % 8) AS key,
  CASE WHEN event_type IN ('view', 'click') THEN 'R' WHEN event_type = 'error' THEN 'D' ELSE 'W' END AS op, event_type AS value FROM events),
txns AS (SELECT txn_id, min(seq) AS begin_seq, max(seq) AS last_seq, max(seq) + 1 + 4 * (txn_id % 3) AS commit_seq, CAST(txn_id % 5 AS INTEGER) AS lvl FROM ops GROUP BY txn_id),
ws AS (SELECT txn_id, key, max(seq) AS seq, arg_max(op, seq) = 'D' AS deleted, CASE WHEN arg_max(op, seq) <> 'D' THEN arg_max(value, seq) END AS value FROM ops WHERE op IN ('W', 'D') GROUP BY 1, 2),
cm AS (SELECT ws.*, begin_seq, commit_seq, lvl FROM ws JOIN txns USING (txn_id)),
ww AS (SELECT a.txn_id, a.key, max(b.commit_seq) AS other_commit FROM cm a JOIN cm b ON a.key = b.key AND (b.commit_seq, b.txn_id) < (a.commit_seq, a.txn_id) AND b.commit_seq > a.begin_seq GROUP BY 1, 2),
lost AS (SELECT * FROM ww WHERE EXISTS (FROM ops WHERE ops.txn_id = ww.txn_id AND ops.key = ww.key AND op = 'R')),
verdict AS (SELECT txn_id, lvl, coalesce(w, 0) AS ww, coalesce(l, 0) AS lost, CASE WHEN lvl = 2 AND coalesce(w, 0) + coalesce(l, 0) > 0 OR lvl = 3 AND coalesce(w, 0) > 0 THEN 'ABORT' ELSE 'COMMIT' END AS verdict
  FROM txns LEFT JOIN (SELECT txn_id, count(*) AS w FROM ww GROUP BY 1) USING (txn_id) LEFT JOIN (SELECT txn_id, count(*) AS l FROM lost GROUP BY 1) USING (txn_id)),
rd AS (SELECT o.txn_id, o.seq, o.key, begin_seq, commit_seq, lvl FROM ops o JOIN txns USING (txn_id) WHERE op = 'R'),
cv AS (SELECT key, commit_seq AS version, arg_max(CASE WHEN NOT deleted THEN value END, txn_id) AS value0, arg_max(deleted, txn_id) AS deleted, list(value ORDER BY txn_id DESC)[1] AS value FROM cm GROUP BY 1, 2),
snap AS (SELECT rd.txn_id, rd.seq, rd.key, rd.begin_seq AS snapshot, CASE WHEN NOT cv.deleted THEN cv.version END AS version, CASE WHEN NOT cv.deleted THEN cv.value END AS value FROM rd ASOF LEFT JOIN cv ON rd.key = cv.key AND rd.begin_seq >= cv.version),
cur AS (SELECT rd.txn_id, rd.seq, rd.key, CASE WHEN NOT cv.deleted THEN cv.value END AS value FROM rd ASOF LEFT JOIN cv ON rd.key = cv.key AND rd.seq >= cv.version),
wr AS (SELECT ops.*, commit_seq FROM ops JOIN txns USING (txn_id) WHERE op <> 'R'),
dirt AS (SELECT rd.txn_id, rd.seq, rd.key, CASE WHEN wr.op = 'W' THEN wr.value END AS value, coalesce(wr.txn_id <> rd.txn_id AND wr.commit_seq > rd.seq, false) AS dirty FROM rd ASOF LEFT JOIN wr ON rd.key = wr.key AND rd.seq > wr.seq),
own AS (SELECT rd.txn_id, rd.seq, rd.key, wr.txn_id IS NOT NULL AS own, CASE WHEN wr.op = 'W' THEN wr.value END AS own_value FROM rd ASOF LEFT JOIN wr ON rd.key = wr.key AND rd.txn_id = wr.txn_id AND rd.seq > wr.seq),
lm AS (SELECT txn_id, key, CASE WHEN bool_or(op <> 'R') THEN 'X' ELSE 'S' END AS mode, min(seq) AS since FROM ops GROUP BY 1, 2),
lc AS (SELECT r.txn_id AS requester, h.txn_id AS holder, r.key, r.mode AS asked, h.mode AS held FROM lm r JOIN lm h ON r.key = h.key AND r.txn_id <> h.txn_id AND h.since < r.since JOIN txns t ON t.txn_id = h.txn_id
  WHERE r.since < t.commit_seq AND (h.mode = 'X' OR r.mode = 'X')),
gaps AS (SELECT txn_id, min(key) AS lo, max(key) AS hi FROM ops GROUP BY 1),
acks AS (SELECT event_type AS node, max(event_id) + 1 AS match_index FROM events GROUP BY 1),
votes AS (SELECT event_id // 50 AS term, user_id % 5 AS node, CASE WHEN arg_min(event_type, event_id) IN ('view', 'click', 'signup') THEN 'n1' ELSE 'n2' END AS candidate FROM events GROUP BY 1, 2),
leader AS (SELECT event_id + 1 AS index, event_id // 100 + 1 AS term, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS command, concat('user:', user_id) AS key, event_type AS value FROM events),
follower AS (SELECT index, CASE WHEN index * 100 > (SELECT n FROM c) * 90 THEN term - 1 ELSE term END AS term, command, key, value FROM leader WHERE index * 100 <= (SELECT n FROM c) * 95),
seg AS (SELECT CAST((version - 1) // greatest(1, (SELECT n FROM c) // 20) AS BIGINT) AS segment_id, *, {nk("key")} AS nkey, CAST(strlen(key) + CASE WHEN deleted THEN 0 ELSE strlen(value) END AS BIGINT) AS b FROM kv),
man AS (SELECT segment_id, arg_min(key, (nkey, length(key), key)) AS min_key, arg_max(key, (nkey, length(key), key)) AS max_key, min(version) AS min_version, max(version) AS max_version, count(*) AS rows, CAST(sum(b) AS BIGINT) AS bytes FROM seg GROUP BY 1),
lev AS (SELECT *, CASE WHEN segment_id >= 12 THEN 0 WHEN segment_id >= 6 THEN 1 ELSE 2 END AS level FROM man)
"""
