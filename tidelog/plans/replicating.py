"""Queries of the replicated log, and the streaming front end's batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import replication as rp
from .registry import query
from .relations import Relations

_fold = "SELECT key, value, version FROM (SELECT key, max(index) AS version, arg_max(command, index) AS c, arg_max(value, index) AS value FROM {} GROUP BY 1) WHERE c = 'put'"


@query("SELECT term, candidate, count(*) AS votes FROM votes GROUP BY 1, 2 HAVING count(*) * 2 > 5")
def election_winner(r: Relations) -> DataFrame:
    return rp.winners(r.votes, 5)


@query("""SELECT max(index) AS commit_index FROM leader WHERE term = (SELECT max(term) FROM leader)
  AND (SELECT count(*) FROM acks WHERE match_index >= index) * 2 > (SELECT count(*) FROM acks)""")
def raft_commit_index(r: Relations) -> DataFrame:
    return rp.commit_index(r.acks, r.leader, r.leader.agg(F.max("term")).first()[0])


@query("SELECT min(CASE WHEN l.term IS DISTINCT FROM f.term THEN index END) AS first_mismatch, count(*) FILTER (l.term IS NULL) AS extra, count(*) FILTER (f.term IS NULL) AS missing FROM leader l FULL JOIN follower f USING (index)")
def log_divergence(r: Relations) -> DataFrame:
    return rp.divergence(r.leader, r.follower)


@query("SELECT index, term, command, key, value FROM leader l WHERE NOT EXISTS (FROM follower f WHERE f.index = l.index AND f.term = l.term) ORDER BY index LIMIT 100")
def log_suffix_to_send(r: Relations) -> DataFrame:
    return rp.suffix_to_send(r.leader, r.follower).select("index", "term", "command", "key", "value")


@query(_fold.format("leader"))
def state_machine_apply(r: Relations) -> DataFrame:
    return rp.fold(r.leader)


@query(_fold.format("leader"))
def snapshot_plus_tail(r: Relations) -> DataFrame:
    base = rp.fold(r.leader.where(F.col("index") <= r.half))
    return rp.snapshot_plus_tail(base, r.leader.where(F.col("index") > r.half))


@query("SELECT index, term, command, key, value FROM leader")
def log_after_truncate(r: Relations) -> DataFrame:
    """The follower after taking the leader's entries from its 80th percent on."""
    return rp.truncate_and_append(r.follower, r.leader.where(F.col("index") * 100 > r.n * 80)).select("index", "term", "command", "key", "value")


def _batches(r: Relations) -> DataFrame:
    b = F.floor((F.col("index") - 1) / 4) + 1
    items = F.sort_array(F.collect_list(F.struct("index", "key", "value")))
    g = r.leader.groupBy(b.alias("index")).agg(F.max("term").alias("term"), items.alias("i"))
    return g.select("index", "term", F.lit("put").alias("command"), F.transform("i", lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value"))).alias("items"))


@query("SELECT (index - 1) // 4 + 1 AS index, CAST((index - 1) % 4 AS INTEGER) AS pos, key, value FROM leader")
def batch_explode(r: Relations) -> DataFrame:
    return rp.explode_batches(_batches(r)).select("index", F.col("pos").cast("int").alias("pos"), "key", "value")


@query("SELECT key, (max(index) - 1) // 4 + 1 AS version, arg_max(value, index) AS value FROM leader GROUP BY 1")
def replicated_kv_state(r: Relations) -> DataFrame:
    """State after exploding batch commands; within one index the later item wins."""
    x = rp.explode_batches(_batches(r)).withColumn("index", F.col("index") * 1000 + F.col("pos"))
    return rp.fold(x).select("key", F.floor(F.col("version") / 1000).alias("version"), "value")


@query("SELECT key, value FROM live")
def snapshot_roundtrip(r: Relations) -> DataFrame:
    """Serialised and restored; keys hold colons."""
    from ..operators.reads import latest

    return rp.restore(rp.serialize(latest(r.kv)))


@query("SELECT key, version, value FROM live")
def stream_latest(r: Relations) -> DataFrame:
    """§2.12: the version log as a stream, folded to the newest version per key."""
    from ..streaming import replay_latest

    return replay_latest(r.spark, f"{r.dir}/events.parquet").where("not deleted").select("key", "version", "value")
