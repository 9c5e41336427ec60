"""Queries of transactions and locks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import transactions as tx
from ..scratch import stored
from .registry import query
from .relations import Relations


@query("SELECT txn_id, lvl, CASE WHEN lvl >= 2 THEN begin_seq END AS snapshot FROM txns")
def txn_snapshots(r: Relations) -> DataFrame:
    """Levels from repeatable read on pin a snapshot."""
    return r.txns.select("txn_id", "lvl", F.when(F.col("lvl") >= 2, F.col("begin_seq")).alias("snapshot"))


@query("SELECT txn_id, seq, key, snapshot, version, value FROM snap")
def asof_snapshot_reads(r: Relations) -> DataFrame:
    return tx.snapshot_reads(r.ops, r.txns).select("txn_id", "seq", "key", "snapshot", "version", "value")


@query("""SELECT s.txn_id, count(*) AS reads, count(*) FILTER (s.value IS DISTINCT FROM n.value) AS stale_reads FROM snap s JOIN (
  SELECT rd.txn_id, rd.seq, rd.key, CASE WHEN NOT cv.deleted THEN cv.value END AS value FROM rd ASOF LEFT JOIN cv ON rd.key = cv.key AND rd.commit_seq - 1 >= cv.version) n USING (txn_id, seq, key) GROUP BY 1""")
def si_read_validation(r: Relations) -> DataFrame:
    return tx.read_validation(r.ops, r.txns)


@query("SELECT txn_id, key, other_commit FROM ww")
def ww_conflict(r: Relations) -> DataFrame:
    return tx.ww_conflicts(r.ops, r.txns)


@query("""SELECT txn_id, other_commit FROM (SELECT txn_id, begin_seq, lag(commit_seq) OVER (ORDER BY commit_seq, txn_id) AS other_commit
  FROM (SELECT DISTINCT txn_id, commit_seq, begin_seq FROM cm)) WHERE other_commit > begin_seq""")
def ww_conflict_global(r: Relations) -> DataFrame:
    return tx.ww_conflicts_global(r.ops, r.txns)


@query("SELECT txn_id, key, other_commit FROM lost")
def lost_update(r: Relations) -> DataFrame:
    return tx.lost_updates(r.ops, r.txns)


@query("SELECT txn_id, seq, key, own, CASE WHEN own THEN own_value ELSE value END AS value FROM own JOIN snap USING (txn_id, seq, key)")
def read_your_writes(r: Relations) -> DataFrame:
    return tx.read_your_writes(r.ops, r.txns)


@query("SELECT txn_id, seq, key, value FROM dirt")
def dirty_read_view(r: Relations) -> DataFrame:
    """What a read sees if uncommitted writes show."""
    return tx.uncommitted_reads(r.ops, r.txns).select("txn_id", "seq", "key", "value")


@query("SELECT txn_id, seq, key FROM dirt WHERE dirty")
def dirty_reads(r: Relations) -> DataFrame:
    return tx.uncommitted_reads(r.ops, r.txns).where("dirty").select("txn_id", "seq", "key")


@query("""SELECT txn_id, seq, key, lvl, CASE WHEN own THEN own_value WHEN lvl = 0 THEN coalesce(dirt.value, cur.value) WHEN lvl = 1 THEN cur.value ELSE snap.value END AS value
FROM own JOIN txns USING (txn_id) JOIN snap USING (txn_id, seq, key) JOIN cur USING (txn_id, seq, key) JOIN dirt USING (txn_id, seq, key)""")
def isolation_reads(r: Relations) -> DataFrame:
    return tx.isolation_reads(r.ops, r.txns)


@query("""SELECT txn_id, key, value FROM (SELECT txn_id, key, own, own_value, value FROM own JOIN snap USING (txn_id, seq, key) JOIN txns USING (txn_id)
  WHERE lvl >= 2 AND key BETWEEN 'acct:2' AND 'acct:5' QUALIFY row_number() OVER (PARTITION BY txn_id, key ORDER BY seq DESC) = 1), LATERAL (SELECT CASE WHEN own THEN own_value ELSE value END AS v) t
WHERE v IS NOT NULL""".replace("SELECT txn_id, key, value FROM (", "SELECT txn_id, key, v AS value FROM (", 1))
def txn_range_query(r: Relations) -> DataFrame:
    """T4: the last read per key of [acct:2, acct:5] of snapshot transactions, own writes laid over."""
    rows = tx.read_your_writes(r.ops, r.txns).join(r.txns.where("lvl >= 2").select("txn_id"), "txn_id", "left_semi").where("key between 'acct:2' and 'acct:5'")
    m = F.max(F.struct("seq", "value")).alias("m")
    return rows.groupBy("txn_id", "key").agg(m).select("txn_id", "key", F.col("m.value").alias("value")).where("value is not null")


@query("SELECT txn_id, lvl, ww, lost, verdict FROM verdict")
def commit_verdicts(r: Relations) -> DataFrame:
    return tx.verdicts(r.ops, r.txns)


@query()
def commit_replay(r: Relations) -> DataFrame:
    """T5 with aborted transactions left out; a test replays it one by one."""
    return tx.replay(r.ops, r.txns, lambda df: stored(df, "replay")[0])


@query("SELECT lvl, count(*) FILTER (verdict = 'COMMIT') AS committed, count(*) FILTER (verdict = 'ABORT') AS aborted FROM verdict GROUP BY 1")
def txn_outcomes(r: Relations) -> DataFrame:
    v = tx.verdicts(r.ops, r.txns)
    return v.groupBy("lvl").agg(F.count_if(F.col("verdict") == "COMMIT").alias("committed"), F.count_if(F.col("verdict") == "ABORT").alias("aborted"))


@query("""SELECT key, version, value FROM (SELECT key, max(commit_seq) AS version, arg_max(deleted, (commit_seq, txn_id)) AS d, list(value ORDER BY commit_seq DESC, txn_id DESC)[1] AS value
  FROM cm JOIN verdict USING (txn_id) WHERE verdict = 'COMMIT' GROUP BY 1) WHERE NOT d""")
def committed_state(r: Relations) -> DataFrame:
    return tx.committed_state(r.ops, r.txns)


@query("""SELECT DISTINCT txn_id, key FROM (SELECT txn_id, key, value, lag(value) OVER w AS prev, row_number() OVER w AS n FROM cur WINDOW w AS (PARTITION BY txn_id, key ORDER BY seq)) WHERE n > 1 AND prev IS DISTINCT FROM value""")
def non_repeatable_reads(r: Relations) -> DataFrame:
    return tx.non_repeatable(r.ops, r.txns)


@query("""SELECT t.txn_id, count(*) AS phantom_commits FROM (SELECT DISTINCT txn_id FROM rd WHERE key BETWEEN 'acct:2' AND 'acct:5') t JOIN txns USING (txn_id)
JOIN (SELECT DISTINCT txn_id AS other, commit_seq AS at_ FROM cm WHERE key BETWEEN 'acct:2' AND 'acct:5') x ON at_ > begin_seq AND at_ <= last_seq AND other <> t.txn_id GROUP BY 1""")
def phantom_reads(r: Relations) -> DataFrame:
    return tx.phantoms(r.ops, r.txns, "acct:2", "acct:5")


@query("""SELECT a AS txn_a, b AS txn_b FROM (SELECT DISTINCT x.txn_id AS a, y.txn_id AS b FROM (SELECT DISTINCT txn_id, key, begin_seq, commit_seq FROM rd) x JOIN cm y ON x.key = y.key AND x.txn_id <> y.txn_id AND x.begin_seq < y.commit_seq AND y.begin_seq < x.commit_seq) rw
WHERE a < b AND EXISTS (FROM (SELECT DISTINCT x.txn_id AS a2, y.txn_id AS b2 FROM (SELECT DISTINCT txn_id, key, begin_seq, commit_seq FROM rd) x JOIN cm y ON x.key = y.key AND x.txn_id <> y.txn_id AND x.begin_seq < y.commit_seq AND y.begin_seq < x.commit_seq) z WHERE z.a2 = rw.b AND z.b2 = rw.a)
AND NOT EXISTS (FROM cm p JOIN cm q ON p.key = q.key WHERE p.txn_id = rw.a AND q.txn_id = rw.b)""")
def write_skew(r: Relations) -> DataFrame:
    return tx.write_skew(r.ops, r.txns)


@query("SELECT requester, holder, key, asked, held FROM lc")
def lock_conflicts(r: Relations) -> DataFrame:
    return tx.lock_conflicts(r.ops, r.txns)


@query("SELECT DISTINCT a.requester AS txn_a, a.holder AS txn_b FROM lc a JOIN lc b ON a.requester = b.holder AND a.holder = b.requester WHERE a.requester < a.holder")
def deadlock_pairs(r: Relations) -> DataFrame:
    return tx.deadlocks(r.ops, r.txns)


@query("SELECT key, count(*) AS holders, count(*) FILTER (mode = 'X') AS exclusive, count(*) FILTER (mode = 'S') AS shared FROM lm GROUP BY 1")
def lock_info(r: Relations) -> DataFrame:
    """A14."""
    return r.locks.groupBy("key").agg(F.count(F.lit(1)).alias("holders"), F.count_if(F.col("mode") == "X").alias("exclusive"), F.count_if(F.col("mode") == "S").alias("shared"))


_life = "(SELECT {} FROM {} JOIN txns t USING (txn_id))"
_together = "a.txn_id <> b.txn_id AND a.begin_seq < b.commit_seq AND b.begin_seq < a.commit_seq"
_g = _life.format("txn_id, lo, hi, begin_seq, commit_seq", "gaps")


@query(f"SELECT a.txn_id AS txn_a, b.txn_id AS txn_b FROM {_g} a JOIN {_g} b ON a.txn_id < b.txn_id AND {_together} AND a.lo <= b.hi AND b.lo <= a.hi")
def gap_conflicts(r: Relations) -> DataFrame:
    return tx.gap_conflicts(r.gaps, r.txns)


@query(f"SELECT a.txn_id, a.key, b.txn_id AS gap_owner FROM {_life.format('txn_id, key, begin_seq, commit_seq', 'ws')} a JOIN {_g} b ON {_together} AND a.key BETWEEN b.lo AND b.hi")
def gap_blocked_writes(r: Relations) -> DataFrame:
    return tx.gap_blocked_writes(tx.write_sets(r.ops).select("txn_id", "key"), r.gaps, r.txns)


#: (held locks, request) -> granted, as the lock table decides it
CASES = [
    ([], "S", 1), ([], "X", 1), ([("S", 1)], "S", 2), ([("S", 1)], "X", 2), ([("X", 1)], "S", 2), ([("X", 1)], "X", 2), ([("S", 1)], "S", 1),
    ([("S", 1)], "X", 1), ([("X", 1)], "S", 1), ([("X", 1)], "X", 1), ([("S", 1), ("S", 2)], "S", 3), ([("S", 1), ("S", 2)], "X", 1), ([("S", 1), ("S", 2)], "X", 3),
]
_held = ", ".join(f"({i}, '{m}', {t})" for i, (h, _, _) in enumerate(CASES) for m, t in h)
_req = ", ".join(f"({i}, '{m}', {t})" for i, (_, m, t) in enumerate(CASES))


@query(f"SELECT q.case_id, count(h.txn) FILTER (h.txn <> q.txn AND (h.mode = 'X' OR q.mode = 'X')) = 0 AS granted FROM (VALUES {_req}) q(case_id, mode, txn) LEFT JOIN (VALUES {_held}) h(case_id, mode, txn) USING (case_id) GROUP BY 1")
def lock_matrix(r: Relations) -> DataFrame:
    """Shared locks are compatible; an exclusive one meets no other transaction's."""
    held = r.spark.createDataFrame([(i, m, t) for i, (h, _, _) in enumerate(CASES) for m, t in h], "case_id int, held string, holder int")
    req = r.spark.createDataFrame([(i, m, t) for i, (_, m, t) in enumerate(CASES)], "case_id int, asked string, txn int")
    bad = (F.col("holder") != F.col("txn")) & ((F.col("held") == "X") | (F.col("asked") == "X"))
    return req.join(held, "case_id", "left").groupBy("case_id").agg((F.count_if(bad) == 0).alias("granted"))
