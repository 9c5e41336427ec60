"""Tiers, segments, manifests, compaction and garbage collection as queries over the version log."""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bloom_positions, nkey, ratio, record_bytes
from ..scratch import stored
from .reads import newest


def merge_on_read(tiers: DataFrame) -> DataFrame:
    """The newest row of the first tier that has the key; tombstones shadow lower tiers."""
    first = F.min(F.struct("tier", (-F.col("version")).alias("v"), "version", "value", "deleted")).alias("m")
    return tiers.groupBy("key").agg(first).where(~F.col("m.deleted")).select("key", "m.version", "m.value", "m.tier")


def manifest(kv: DataFrame, segment: Column) -> DataFrame:
    """Key range, version range, rows and bytes per segment."""
    k = F.struct(nkey("key").alias("n"), F.length("key").alias("l"), F.col("key").alias("k"))
    g = kv.withColumn("segment_id", segment).groupBy("segment_id").agg(
        F.min(k).alias("a"), F.max(k).alias("z"), F.min("version").alias("min_version"), F.max("version").alias("max_version"),
        F.count(F.lit(1)).alias("rows"), F.sum(record_bytes("key", "value", "deleted")).alias("bytes"),
    )
    return g.select("segment_id", F.col("a.k").alias("min_key"), F.col("z.k").alias("max_key"), "min_version", "max_version", "rows", "bytes")


def files_touched(man: DataFrame, start: str, end: str, as_of: int | None = None) -> DataFrame:
    """Segments that a read of the range and snapshot cannot skip."""
    out = man.where((nkey("min_key") <= nkey(F.lit(end))) & (nkey("max_key") >= nkey(F.lit(start))))
    return out if as_of is None else out.where(F.col("min_version") <= as_of)


def flush_segments(kv: DataFrame, threshold: int, width: int = 1_000_000) -> DataFrame:
    """Segment of each write on a fixed grid of bytes; running sums go range by range."""
    b = kv.withColumn("bytes", record_bytes("key", "value", "deleted")).withColumn("_g", F.floor(F.col("version") / width))
    sums = b.groupBy("_g").agg(F.sum("bytes").alias("s"))
    base = sums.select("_g", F.coalesce(F.sum("s").over(Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    w = Window.partitionBy("_g").orderBy("version").rowsBetween(Window.unboundedPreceding, -1)
    prev = F.coalesce(F.sum("bytes").over(w), F.lit(0)) + F.col("_b")
    return b.join(base, "_g").withColumn("segment_id", F.floor(prev / threshold).cast("long")).drop("_g", "_b")


def tier_stats(tiers: DataFrame) -> DataFrame:
    """A2, A3: keys, versions and bytes per tier, and their rollup (-1)."""
    per = tiers.groupBy("tier", "key").agg(F.count(F.lit(1)).alias("n"), F.sum(record_bytes("key", "value", "deleted")).alias("b"))
    one = per.groupBy("tier").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("b").alias("b"))
    return one.rollup("tier").agg(F.sum("k").alias("num_keys"), F.sum("n").alias("num_versions"), F.sum("b").alias("num_bytes")).select(F.coalesce("tier", F.lit(-1)).cast("int").alias("tier"), "num_keys", "num_versions", "num_bytes")


def gc_horizon(kv: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The oldest version that a live snapshot, or the present, may read."""
    cur = kv.agg(F.max("version").alias("c"))
    live = snapshots.where("not released").agg(F.min("version").alias("s"))
    return cur.unionByName(live, allowMissingColumns=True).agg(F.least(F.max("c"), F.max("s")).alias("horizon"))


def gc_safe(kv: DataFrame, horizon: int) -> DataFrame:
    """M4: every version above the horizon and, per key, the newest one at most it unless that is a tombstone."""
    old = newest(kv, horizon).where(~F.col("deleted")).select("key", "version", "value", "deleted")
    return kv.where(F.col("version") > horizon).select("key", "version", "value", "deleted").unionByName(old)


def gc_threshold_literal(kv: DataFrame, horizon: int) -> DataFrame:
    """M4 to the letter (D7): versions from the horizon on."""
    return kv.where(F.col("version") >= horizon)


def keep_n_versions(kv: DataFrame, n: int) -> DataFrame:
    """M7: the newest n versions of each key."""
    w = Window.partitionBy("key").orderBy(F.desc("version"))
    return kv.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def compaction_trigger(man: DataFrame, l0_files: int, base_bytes: int) -> DataFrame:
    """M2: levels over their limit: level 0 by files, others by bytes times ten per level."""
    g = man.groupBy("level").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))
    limit = F.when(F.col("level") == 0, F.lit(l0_files)).otherwise(F.lit(base_bytes) * F.pow(F.lit(10.0), F.greatest(F.col("level") - 1, F.lit(0)))).cast("long")
    size = F.when(F.col("level") == 0, F.col("files")).otherwise(F.col("bytes"))
    return g.withColumn("size_limit", limit).withColumn("triggered", size >= limit)


def overlapping(a: DataFrame, b: DataFrame, step: int = 1) -> DataFrame:
    """Pairs (a_id, b_id) of rows (id, lo, hi) whose closed integer intervals overlap.

    Intervals are cut into cells of ``step``; a pair is found in the first cell that both share, so
    the join is an equi-join and needs no removal of repeats.
    """
    cut = lambda d, p: d.select(F.col("id").alias(f"{p}_id"), F.col("lo").alias(f"{p}_lo"), F.col("hi").alias(f"{p}_hi"), F.explode(F.sequence(F.floor(F.col("lo") / step), F.floor(F.col("hi") / step))).alias("cell"))
    j = cut(a, "a").join(cut(b, "b"), "cell")
    first = F.floor(F.greatest("a_lo", "b_lo") / step) == F.col("cell")
    return j.where(first & (F.col("a_lo") <= F.col("b_hi")) & (F.col("b_lo") <= F.col("a_hi"))).select("a_id", "b_id")


def compaction_output(inputs: DataFrame, horizon: int, bottom: bool) -> DataFrame:
    """M2: what a compaction writes: versions above the horizon and the newest below; tombstones go at the bottom only."""
    top = newest(inputs, horizon)
    if bottom:
        top = top.where(~F.col("deleted"))
    return inputs.where(F.col("version") > horizon).select("key", "version", "value", "deleted").unionByName(top.select("key", "version", "value", "deleted"))


def sorted_for_write(kv: DataFrame, partitions: int) -> DataFrame:
    """Range-partitioned by natural key and sorted, so files have disjoint key ranges."""
    out = kv.withColumn("nkey", nkey("key"))
    return out.repartitionByRange(partitions, "nkey").sortWithinPartitions("nkey", F.desc("version"))


def apply_batch(batch: DataFrame, base: int) -> DataFrame:
    """M0: rows (ordinal, op, key, value) as versions base + 1, base + 2, ... in order of ordinal."""
    from .reads import numbered

    rows = numbered(batch, "ordinal", "_n")
    dead = F.upper("op").isin("D", "DEL", "DELETE")
    return rows.select("key", (F.col("_n") + base).alias("version"), F.when(~dead, F.col("value")).alias("value"), dead.alias("deleted"))


def bloom(keys: DataFrame, bits: int, hashes: int) -> DataFrame:
    """M8: the set positions of a filter over ``key``."""
    return keys.select(F.explode(bloom_positions("key", bits, hashes)).alias("position")).distinct()


def may_contain(probes: DataFrame, filter_: DataFrame, bits: int, hashes: int) -> DataFrame:
    """M8: probes with ``maybe``: every position of the key is set."""
    pos = probes.select("key").distinct().select("key", F.explode(bloom_positions("key", bits, hashes)).alias("position")).distinct()
    hit = pos.join(filter_.withColumn("_s", F.lit(1)), "position", "left").groupBy("key").agg((F.count("_s") == F.count(F.lit(1))).alias("maybe"))
    return probes.join(hit, "key")


def cache_sim(access: DataFrame, capacity: int, width: int = 65_536) -> DataFrame:
    """Hit flags of a least-recently-used cache of ``capacity`` keys over (seq, key); ``seq`` is unique.

    Accesses are cut into ranges of ``width`` positions, and each range is replayed from the cache's content
    at its start: the ``capacity`` keys used last. Those come from every range's own last uses, merged with
    the ranges 1, 2, 4, ... before it until all have ``capacity`` keys or no range is left to add.
    """
    g = F.floor(F.col("seq") / width).cast("long")
    rows = access.select(g.alias("g"), "seq", "key")
    ends = rows.agg(F.min("g").alias("lo"), F.max("g").alias("hi")).first()

    def newest_keys(d: DataFrame) -> DataFrame:
        one = d.groupBy("g", "key").agg(F.max("seq").alias("seq"))
        at = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("seq")))
        return stored(one.withColumn("_r", at).where(F.col("_r") <= capacity).drop("_r"), "recent")[0]

    recent, reach = newest_keys(rows), 1
    while ends.lo is not None and reach <= ends.hi - ends.lo:
        short = recent.groupBy("g").count().where((F.col("count") < capacity) & (F.col("g") - ends.lo >= reach))
        present = recent.select("g").distinct().where(F.col("g") - ends.lo >= reach).count()
        if short.isEmpty() and present == ends.hi - ends.lo + 1 - reach:
            break
        earlier = recent.withColumn("g", F.col("g") + reach).where(F.col("g") <= ends.hi)
        recent, reach = newest_keys(recent.unionByName(earlier)), reach * 2
    kind = access.schema["key"].dataType.simpleString()

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["own", "seq"], kind="stable")
        held: OrderedDict = OrderedDict()
        hits = []
        for key, own in zip(pdf["key"], pdf["own"], strict=True):
            if own:
                hits.append(key in held)
            held[key] = None
            held.move_to_end(key)
            if len(held) > capacity:
                held.popitem(last=False)
        return pdf.loc[pdf["own"], ["seq", "key"]].assign(hit=np.array(hits, bool))

    start = recent.withColumn("g", F.col("g") + 1).join(rows.select("g").distinct(), "g", "left_semi")
    both = rows.withColumn("own", F.lit(True)).unionByName(start.withColumn("own", F.lit(False)))
    return both.groupBy("g").applyInPandas(replay, f"seq long, key {kind}, hit boolean")


def hit_rate(sim: DataFrame) -> DataFrame:
    """A9."""
    g = sim.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    return g.withColumn("hit_rate", ratio("hits", F.col("hits") + F.col("misses")))


