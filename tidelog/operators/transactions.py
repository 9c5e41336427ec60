"""Transactions and locks replayed as set queries over txn_ops, txns and the lock tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .reads import as_of_join


def write_sets(ops: DataFrame) -> DataFrame:
    """(txn_id, key, value, deleted, seq): the last write of each transaction to each key."""
    m = F.max(F.struct("seq", "op", "value")).alias("m")
    return ops.where("op in ('W', 'D')").groupBy("txn_id", "key").agg(m).select("txn_id", "key", F.when(F.col("m.op") != "D", F.col("m.value")).alias("value"), (F.col("m.op") == "D").alias("deleted"), F.col("m.seq").alias("seq"))


def committed(ops: DataFrame, txns: DataFrame) -> DataFrame:
    """The version log that results if every transaction commits: version = commit_seq, ties by txn_id."""
    w = write_sets(ops).join(txns.select("txn_id", "commit_seq", "begin_seq", "lvl"), "txn_id")
    return w.withColumn("version", F.col("commit_seq"))


def last_per_version(kv: DataFrame) -> DataFrame:
    """One row per (key, version): that of the largest txn_id."""
    return kv.groupBy("key", "version").agg(F.max(F.struct("txn_id", "value", "deleted")).alias("m")).select("key", "version", "m.value", "m.deleted")


def ww_conflicts(ops: DataFrame, txns: DataFrame) -> DataFrame:
    """Writes whose key was committed by another transaction after the snapshot and before the own commit.

    Per key, the commit just before the own one decides, so a lag replaces the self-join.
    """
    w = Window.partitionBy("key").orderBy("commit_seq", "txn_id")
    return committed(ops, txns).withColumn("other_commit", F.lag("commit_seq").over(w)).where("other_commit > begin_seq").select("txn_id", "key", "other_commit")


def ww_conflicts_global(ops: DataFrame, txns: DataFrame, width: int = 100_000) -> DataFrame:
    """D10 to the letter: writers for whom any transaction committed between snapshot and commit.

    Commits are spread over ranges of sequence numbers; only the newest commit before matters.
    """
    commits = committed(ops, txns).select("txn_id", "commit_seq", "begin_seq").distinct().withColumn("_g", F.floor(F.col("commit_seq") / width))
    last = commits.groupBy("_g").agg(F.max("commit_seq").alias("m"))
    before = last.select("_g", F.lag("m").over(Window.orderBy("_g")).alias("_b"))  # one row per range
    inner = F.lag("commit_seq").over(Window.partitionBy("_g").orderBy("commit_seq", "txn_id"))
    return commits.join(before, "_g").withColumn("other_commit", F.coalesce(inner, "_b")).where("other_commit > begin_seq").select("txn_id", "other_commit")


def lost_updates(ops: DataFrame, txns: DataFrame) -> DataFrame:
    """Transactions that read a key, write it, and conflict on it."""
    reads = ops.where("op = 'R'").select("txn_id", "key").distinct()
    return ww_conflicts(ops, txns).join(reads, ["txn_id", "key"], "left_semi")


def snapshot_reads(ops: DataFrame, txns: DataFrame) -> DataFrame:
    """Every read as of its transaction's begin."""
    readers = ops.where("op = 'R'").join(txns.select("txn_id", "begin_seq"), "txn_id").select("key", "txn_id", "seq", F.col("begin_seq").alias("snapshot"))
    return as_of_join(readers, last_per_version(committed(ops, txns)))


def committed_reads(ops: DataFrame, txns: DataFrame, at: str = "seq") -> DataFrame:
    readers = ops.where("op = 'R'").select("key", "txn_id", "seq").join(txns.select("txn_id", "commit_seq"), "txn_id").withColumn("snapshot", F.col(at))
    return as_of_join(readers.select("key", "txn_id", "seq", "snapshot"), last_per_version(committed(ops, txns)))


def read_validation(ops: DataFrame, txns: DataFrame) -> DataFrame:
    """Reads whose snapshot value differs from the value just before commit, per transaction."""
    keys = ["txn_id", "seq", "key"]
    snap = snapshot_reads(ops, txns).select(*keys, F.col("value").alias("then"))
    t = txns.select("txn_id", (F.col("commit_seq") - 1).alias("before"))
    readers = ops.where("op = 'R'").join(t, "txn_id").select("key", "txn_id", "seq", F.col("before").alias("snapshot"))
    now = as_of_join(readers, last_per_version(committed(ops, txns))).select(*keys, F.col("value").alias("now"))
    stale = F.count_if(~F.col("then").eqNullSafe(F.col("now")))
    return snap.join(now, keys).groupBy("txn_id").agg(F.count(F.lit(1)).alias("reads"), stale.alias("stale_reads"))


def own_writes(ops: DataFrame) -> DataFrame:
    """For each read, the transaction's own newest write before it (value null where none or deleted)."""
    w = Window.partitionBy("txn_id", "key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    wrote = F.last(F.when(F.col("op") != "R", F.struct(F.col("op").alias("o"), F.when(F.col("op") == "W", F.col("value")).alias("v"))), ignorenulls=True).over(w)
    return ops.withColumn("_w", wrote).where("op = 'R'").select("txn_id", "seq", "key", F.col("_w").isNotNull().alias("own"), F.col("_w.v").alias("own_value"))


def read_your_writes(ops: DataFrame, txns: DataFrame) -> DataFrame:
    """Snapshot reads with the own write set laid over them."""
    s = snapshot_reads(ops, txns).select("txn_id", "seq", "key", "value")
    return own_writes(ops).join(s, ["txn_id", "seq", "key"]).select("txn_id", "seq", "key", "own", F.when(F.col("own"), F.col("own_value")).otherwise(F.col("value")).alias("value"))


def uncommitted_reads(ops: DataFrame, txns: DataFrame) -> DataFrame:
    """Per read, the newest write of anyone before it, and whether that was still uncommitted and foreign."""
    marks = ops.join(txns.select("txn_id", "commit_seq"), "txn_id")
    w = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("op") != "R", F.struct(F.col("txn_id").alias("t"), F.col("commit_seq").alias("c"), F.when(F.col("op") == "W", F.col("value")).alias("v"))), ignorenulls=True).over(w)
    return marks.withColumn("_w", last).where("op = 'R'").select(
        "txn_id", "seq", "key", F.col("_w.v").alias("value"),
        F.coalesce((F.col("_w.t") != F.col("txn_id")) & (F.col("_w.c") > F.col("seq")), F.lit(False)).alias("dirty"),
    )


def isolation_reads(ops: DataFrame, txns: DataFrame) -> DataFrame:
    """What each read returns at its transaction's level, own writes first."""
    k = ["txn_id", "seq", "key"]
    out = own_writes(ops).join(txns.select("txn_id", "lvl"), "txn_id")
    out = out.join(snapshot_reads(ops, txns).select(*k, F.col("value").alias("snap")), k)
    out = out.join(committed_reads(ops, txns).select(*k, F.col("value").alias("cur")), k)
    out = out.join(uncommitted_reads(ops, txns).select(*k, F.col("value").alias("any")), k)
    by_level = F.when(F.col("lvl") == 0, F.coalesce("any", "cur")).when(F.col("lvl") == 1, F.col("cur")).otherwise(F.col("snap"))
    return out.select(*k, "lvl", F.when(F.col("own"), F.col("own_value")).otherwise(by_level).alias("value"))


def non_repeatable(ops: DataFrame, txns: DataFrame) -> DataFrame:
    """(txn, key) read twice with different committed values."""
    w = Window.partitionBy("txn_id", "key").orderBy("seq")
    r = committed_reads(ops, txns)
    r = r.withColumns({"prev": F.lag("value").over(w), "nth": F.row_number().over(w)})
    return r.where((F.col("nth") > 1) & ~F.col("prev").eqNullSafe(F.col("value"))).select("txn_id", "key").distinct()


def phantoms(ops: DataFrame, txns: DataFrame, start: str, end: str) -> DataFrame:
    """Transactions during whose life another one committed a write inside a range they read.

    Range readers are transactions that read in [start, end]; per key, one pass in commit order.
    """
    inside = F.col("key").between(start, end)
    readers = ops.where((F.col("op") == "R") & inside).groupBy("txn_id").agg(F.countDistinct("key").alias("keys_read")).join(txns, "txn_id")
    commits = committed(ops, txns).where(inside).select(F.col("txn_id").alias("other"), F.col("commit_seq").alias("at")).distinct()
    # lives are short next to the log: cut them into cells, so that the range join is an equi-join
    cell = 64
    r = readers.withColumn("cell", F.explode(F.sequence(F.floor(F.col("begin_seq") / cell), F.floor(F.col("last_seq") / cell))))
    c = commits.withColumn("cell", F.floor(F.col("at") / cell))
    hit = r.join(c, "cell").where("at > begin_seq and at <= last_seq and other <> txn_id")
    return hit.groupBy("txn_id").agg(F.count(F.lit(1)).alias("phantom_commits"))


def verdicts(ops: DataFrame, txns: DataFrame) -> DataFrame:
    """T5 in one pass: a transaction conflicts with any earlier attempted commit."""
    ww = ww_conflicts(ops, txns).groupBy("txn_id").agg(F.count(F.lit(1)).alias("ww"))
    lu = lost_updates(ops, txns).groupBy("txn_id").agg(F.count(F.lit(1)).alias("lu"))
    j = txns.join(ww, "txn_id", "left").join(lu, "txn_id", "left")
    ww_, lu_ = F.coalesce("ww", F.lit(0)), F.coalesce("lu", F.lit(0))
    bad = F.when(F.col("lvl") == 2, (ww_ + lu_) > 0).when(F.col("lvl") == 3, ww_ > 0).otherwise(F.lit(False))
    return j.select("txn_id", "lvl", ww_.cast("long").alias("ww"), lu_.cast("long").alias("lost"), F.when(bad, "ABORT").otherwise("COMMIT").alias("verdict"))


def replay(ops: DataFrame, txns: DataFrame, write) -> DataFrame:
    """T5 exactly: aborted writes abort nobody. ``write(df)`` stores a table and reads it back.

    Verdicts depend on earlier commits only, so repeating the one-pass rule over the transactions that
    still stand settles them in order; it ends when nothing changes.
    """
    w = write(committed(ops, txns).select("txn_id", "key", "commit_seq", "begin_seq", "lvl"))
    state = write(w.select("txn_id").distinct().withColumn("ok", F.lit(True)))
    over = Window.partitionBy("key").orderBy("commit_seq", "txn_id").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        j = w.join(state, "txn_id")
        last = F.max(F.when(F.col("ok"), F.col("commit_seq"))).over(over)
        hit = F.coalesce((last > F.col("begin_seq")) & F.col("lvl").isin(2, 3), F.lit(False))
        new = write(j.withColumn("_bad", hit).groupBy("txn_id").agg((~F.bool_or("_bad")).alias("ok"), F.first("ok").alias("was")))
        changed = new.where("ok <> was").limit(1).count()
        state = new.select("txn_id", "ok")
        if not changed:
            return txns.join(state, "txn_id", "left").select("txn_id", "lvl", F.when(F.coalesce("ok", F.lit(True)), "COMMIT").otherwise("ABORT").alias("verdict"))


def committed_state(ops: DataFrame, txns: DataFrame) -> DataFrame:
    """Latest values after dropping the writes of aborted transactions."""
    ok = verdicts(ops, txns).where("verdict = 'COMMIT'").select("txn_id")
    kv = committed(ops, txns).join(ok, "txn_id", "left_semi")
    m = kv.groupBy("key").agg(F.max(F.struct("commit_seq", "txn_id", "value", "deleted")).alias("m"))
    return m.where(~F.col("m.deleted")).select("key", F.col("m.commit_seq").alias("version"), "m.value")


def lock_modes(ops: DataFrame) -> DataFrame:
    """Record locks: per (txn, key) the strongest mode asked for, and when it was first held."""
    x = F.bool_or(F.col("op") != "R")
    return ops.groupBy("txn_id", "key").agg(F.when(x, "X").otherwise("S").alias("mode"), F.min("seq").alias("since"))


def lock_conflicts(ops: DataFrame, txns: DataFrame) -> DataFrame:
    """Requests that meet an incompatible lock of another live transaction on the key.

    Lives are cut into cells, so the join is on (key, cell) and stays linear on hot keys.
    """
    cell = 64
    held = lock_modes(ops).join(txns.select("txn_id", "commit_seq"), "txn_id")
    h = held.select(F.col("txn_id").alias("holder"), "key", F.col("mode").alias("held"), F.col("since").alias("h0"), F.col("commit_seq").alias("h1")).withColumn("cell", F.explode(F.sequence(F.floor(F.col("h0") / cell), F.floor(F.col("h1") / cell))))
    r = held.select(F.col("txn_id").alias("requester"), "key", F.col("mode").alias("asked"), "since").withColumn("cell", F.floor(F.col("since") / cell))
    bad = (F.col("holder") != F.col("requester")) & (F.col("h0") < F.col("since")) & (F.col("since") < F.col("h1")) & ((F.col("held") == "X") | (F.col("asked") == "X"))
    return r.join(h, ["key", "cell"]).where(bad).select("requester", "holder", "key", "asked", "held")


def deadlocks(ops: DataFrame, txns: DataFrame) -> DataFrame:
    """Pairs that wait for each other."""
    w = lock_conflicts(ops, txns).select("requester", "holder").distinct()
    back = w.select(F.col("requester").alias("holder"), F.col("holder").alias("requester"))
    return w.join(back, ["requester", "holder"], "left_semi").where("requester < holder").select(F.col("requester").alias("txn_a"), F.col("holder").alias("txn_b"))


def write_skew(ops: DataFrame, txns: DataFrame) -> DataFrame:
    """Overlapping pairs that each read a key the other wrote, and wrote no key in common."""
    life = txns.select("txn_id", "begin_seq", "commit_seq")
    rd = ops.where("op = 'R'").select("txn_id", "key").distinct().join(life, "txn_id")
    wr = write_sets(ops).select("txn_id", "key").join(life, "txn_id")
    cell = 64
    cut = lambda d, p: d.select(F.col("txn_id").alias(p), "key", F.col("begin_seq").alias(f"{p}0"), F.col("commit_seq").alias(f"{p}1"), F.explode(F.sequence(F.floor(F.col("begin_seq") / cell), F.floor(F.col("commit_seq") / cell))).alias("cell"))
    live = (F.col("a") != F.col("b")) & (F.col("a0") < F.col("b1")) & (F.col("b0") < F.col("a1"))
    rw = cut(rd, "a").join(cut(wr, "b"), ["key", "cell"]).where(live).select("a", "b").distinct()
    ww = cut(wr, "a").join(cut(wr, "b"), ["key", "cell"]).where(live).select("a", "b").distinct()
    back = rw.select(F.col("a").alias("b"), F.col("b").alias("a"))
    return rw.join(back, ["a", "b"], "left_semi").join(ww, ["a", "b"], "left_anti").where("a < b").select(F.col("a").alias("txn_a"), F.col("b").alias("txn_b"))


def _cells(rows: DataFrame, p: str, *cols: str, cell: int = 64) -> DataFrame:
    """Lives [begin_seq, commit_seq] cut into cells; columns are named with ``p``, ``<p>cell`` is a life's first."""
    of = lambda c: F.floor(F.col(c) / cell)
    kept = [F.col(c).alias(f"{p}{c}") for c in ("txn_id", "begin_seq", "commit_seq", *cols)]
    return rows.select(*kept, of("begin_seq").alias(f"{p}cell"), F.explode(F.sequence(of("begin_seq"), of("commit_seq"))).alias("cell"))


def _live_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of different transactions that live together, each in the first cell they share; columns a_*, b_*."""
    live = (F.col("a_txn_id") != F.col("b_txn_id")) & (F.col("a_begin_seq") < F.col("b_commit_seq")) & (F.col("b_begin_seq") < F.col("a_commit_seq"))
    return a.join(b, "cell").where(live & (F.col("cell") == F.greatest("a_cell", "b_cell")))


def gap_conflicts(gaps: DataFrame, txns: DataFrame) -> DataFrame:
    """Pairs of transactions whose gap locks (txn_id, lo, hi) overlap while both live (equi-join on cells of lives)."""
    g = gaps.join(txns.select("txn_id", "begin_seq", "commit_seq"), "txn_id")
    p = _live_pairs(_cells(g, "a_", "lo", "hi"), _cells(g, "b_", "lo", "hi"))
    return p.where("a_txn_id < b_txn_id and a_lo <= b_hi and b_lo <= a_hi").select(F.col("a_txn_id").alias("txn_a"), F.col("b_txn_id").alias("txn_b"))


def gap_blocked_writes(writes: DataFrame, gaps: DataFrame, txns: DataFrame) -> DataFrame:
    """Writes (txn_id, key) inside a gap that another transaction holds while both live."""
    life = txns.select("txn_id", "begin_seq", "commit_seq")
    p = _live_pairs(_cells(writes.join(life, "txn_id"), "a_", "key"), _cells(gaps.join(life, "txn_id"), "b_", "lo", "hi"))
    return p.where("a_key between b_lo and b_hi").select(F.col("a_txn_id").alias("txn_id"), F.col("a_key").alias("key"), F.col("b_txn_id").alias("gap_owner"))
