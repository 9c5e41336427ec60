"""Replicated-log queries: votes, commit index, divergence, folds and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def winners(votes: DataFrame, nodes: int) -> DataFrame:
    """Candidates with more than half of all nodes, per term."""
    return votes.groupBy("term", "candidate").agg(F.count(F.lit(1)).alias("votes")).where(F.col("votes") * 2 > nodes)


def commit_index(acks: DataFrame, log: DataFrame, term: int) -> DataFrame:
    """The largest index of the current term that a majority of nodes holds; null where there is none.

    Entries of earlier terms are committed only together with one of the leader's own term.
    """
    held = acks.agg(F.sort_array(F.collect_list("match_index"), asc=False).alias("m")).select(F.get("m", F.floor(F.size("m") / 2).cast("int")).alias("i")).first().i  # one row per node
    return log.where((F.col("term") == term) & (F.col("index") <= held)).agg(F.max("index").alias("commit_index"))


def divergence(leader: DataFrame, follower: DataFrame) -> DataFrame:
    """First index where terms differ or an entry is missing, as one row."""
    a, b = leader.select("index", F.col("term").alias("lt")), follower.select("index", F.col("term").alias("ft"))
    j = a.join(b, "index", "full_outer")
    return j.agg(F.min(F.when(~F.col("lt").eqNullSafe(F.col("ft")), F.col("index"))).alias("first_mismatch"), F.count_if(F.col("lt").isNull()).alias("extra"), F.count_if(F.col("ft").isNull()).alias("missing"))


def suffix_to_send(leader: DataFrame, follower: DataFrame, limit: int = 100) -> DataFrame:
    """Entries of the leader that the follower lacks or holds with another term, first ``limit`` in order."""
    return leader.join(follower.select("index", "term"), ["index", "term"], "left_anti").orderBy("index").limit(limit)


def fold(log: DataFrame) -> DataFrame:
    """State after applying put and delete commands in index order."""
    m = log.groupBy("key").agg(F.max(F.struct("index", "command", "value")).alias("m"))
    return m.where("m.command = 'put'").select("key", "m.value", F.col("m.index").alias("version"))


def snapshot_plus_tail(snapshot: DataFrame, tail: DataFrame) -> DataFrame:
    """P5: a snapshot (key, value, version) with later log entries folded over it."""
    base = snapshot.select(F.col("version").alias("index"), F.lit("put").alias("command"), "key", "value")
    return fold(base.unionByName(tail.select("index", "command", "key", "value")))


def truncate_and_append(log: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries replace the log from their first conflicting index on."""
    cut = log.join(entries.select("index", F.col("term").alias("_t")), "index").where("term <> _t").agg(F.min("index").alias("c")).first().c
    kept = log if cut is None else log.where(F.col("index") < cut)
    return kept.unionByName(entries.join(kept.select("index"), "index", "left_anti"))


def explode_batches(batches: DataFrame) -> DataFrame:
    """one row per item of a batch command; the item's place breaks ties within one index."""
    return batches.select("index", "term", "command", F.posexplode("items").alias("pos", "item")).select("index", "term", "command", "pos", "item.key", "item.value")


def serialize(state: DataFrame) -> DataFrame:
    """``key:value`` lines per hash shard, in key order; no task holds the whole state."""
    return state.groupBy(F.pmod(F.xxhash64("key"), F.lit(256)).alias("shard")).agg(F.array_join(F.array_sort(F.collect_list(F.concat("key", F.lit(":"), "value"))), "\n").alias("lines"))


def restore(text: DataFrame) -> DataFrame:
    from ..functions import split_pair

    k, v = split_pair(F.col("line"))
    return text.select(F.explode(F.split("lines", "\n")).alias("line")).select(k.alias("key"), v.alias("value"))


def leaders_by_term(log: DataFrame) -> DataFrame:
    w = Window.partitionBy("term").orderBy("index")
    return log.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
