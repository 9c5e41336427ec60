"""Operators on small literals, and every registered SQL twin on the smallest tables."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidelog.functions import bloom_bits, frame_crc, isolation_level, key_successor, nkey
from tidelog.operators import reads, replication, storage, transactions
from tidelog.plans import QUERIES, SQL
from tidelog.plans.relations import Relations

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    return round(v, 9) if isinstance(v, float) and math.isfinite(v) else v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = sorted(repr(tuple(norm(r[i]) for i in at)) for r in rel.fetchall())
    assert sorted(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect()) == want


def kv(spark, rows):
    return spark.createDataFrame(rows, "key string, version long, value string, deleted boolean")


def test_snapshots_and_tombstones(spark):
    log = kv(spark, [("user:1", 1, "Alice", False), ("user:2", 2, "Bob", False), ("user:1", 3, "Alice Updated", False), ("user:1", 4, "Alice Again", False), ("user:2", 5, None, True)])
    see = lambda at=None: {r.key: r.value for r in reads.latest(log, at).collect()}
    assert see() == {"user:1": "Alice Again"} and see(3) == {"user:1": "Alice Updated", "user:2": "Bob"} and see(0) == {}


def test_natural_ranges(spark):
    log = kv(spark, [(f"key_{i}", i, f"value_{i}", False) for i in range(1, 21)] + [(k, 20 + i, f"fruit_{k}", False) for i, k in enumerate(("apple", "apricot", "banana"), 1)])
    assert [r.key for r in reads.range_scan(log, "key_5", "key_15").collect()] == [f"key_{i}" for i in range(5, 16)]
    assert [r.key for r in reads.prefix_scan(log, "apple").collect()] == ["apple"]
    assert [r.key for r in reads.prefix_range_literal(log, "key_1").collect()] == ["key_1", "key_2"]
    assert reads.pages(log, "key_0", "key_z", 5).groupBy("page").count().count() == 4
    assert [r.key for r in reads.page(log, "key_0", "key_z", 5, "key_6").collect()] == [f"key_{i}" for i in range(6, 12)]
    assert reads.seek(reads.latest(log), "key_9x").first().key == "key_10"


def test_collection_keeps_every_later_read(spark):
    rows, v = [], 0
    for _ in range(10):
        for u in (1, 2, 3):
            v += 1
            rows.append((f"user:{u}", v, str(v), False))
    for _ in range(10):
        for u in (1, 2):
            v += 1
            rows.append((f"user:{u}", v, str(v), v == 50))
    log = kv(spark, rows)
    safe = storage.gc_safe(log, 30)
    assert safe.count() == 23 and storage.gc_threshold_literal(log, 30).count() == 21
    for at in (30, 41, 50):
        assert sorted(reads.latest(safe, at).collect()) == sorted(reads.latest(log, at).collect())
    assert storage.keep_n_versions(log, 5).count() == 15
    out = storage.compaction_output(log, 50, bottom=True)
    assert sorted(reads.latest(out).collect()) == sorted(reads.latest(log).collect())


def test_functions(spark):
    d = spark.createDataFrame([("user:9",), ("",), ("key_10",)], "k string")
    assert [r[0] for r in d.select(key_successor("k")).collect()] == ["user::", "", "key_11"]
    assert [r[0] for r in spark.createDataFrame([("key_10",), ("key_2",)], "k string").orderBy(nkey("k")).collect()] == ["key_2", "key_10"]
    assert spark.range(1).select(bloom_bits(F.lit(1000), 0.01)).first()[0] == int(-1000 * math.log(0.01) / math.log(2) ** 2)
    assert spark.range(1).select(isolation_level(F.lit("serializable"))).first()[0] == 4
    import struct
    import zlib

    body = struct.pack("<BII", 1, 2, 1) + b"abx"
    assert spark.range(1).select(frame_crc(F.lit(1), F.lit("ab"), F.lit("x"))).first()[0] == zlib.crc32(body)


def test_filters_have_no_false_negatives(spark, sf):
    got = QUERIES["bloom_no_false_negatives"](spark, sf).collect()
    assert all(r.maybe for r in got if r.member) and sum(r.maybe for r in got if not r.member) <= 0.05 * len(got)


def test_replay_matches_one_by_one(spark, sf):
    r = Relations(spark, sf)
    writes = {}
    for w in transactions.write_sets(r.ops).collect():
        writes.setdefault(w.txn_id, []).append(w.key)
    last, want = {}, {}
    for t in sorted(r.txns.collect(), key=lambda t: (t.commit_seq, t.txn_id)):
        keys = writes.get(t.txn_id, [])
        want[t.txn_id] = "ABORT" if t.lvl in (2, 3) and any(last.get(k, -1) > t.begin_seq for k in keys) else "COMMIT"
        if want[t.txn_id] == "COMMIT":
            last.update(dict.fromkeys(keys, t.commit_seq))
    assert {x.txn_id: x.verdict for x in QUERIES["commit_replay"](spark, sf).collect()} == want
    assert len(set(want.values())) == 2


def test_interval_pairs(spark):
    rows = spark.createDataFrame([(1, 0, 5), (2, 5, 9), (3, 10, 12), (4, 1, 30)], "id long, lo long, hi long")
    got = {(r.a_id, r.b_id) for r in storage.overlapping(rows, rows, 3).where("a_id < b_id").collect()}
    assert got == {(1, 2), (1, 4), (2, 4), (3, 4)}


def test_empty_log(spark):
    e = kv(spark, [])
    assert reads.latest(e).count() == 0 and reads.range_scan(e, "a", "z").count() == 0 and storage.gc_safe(e, 5).count() == 0
    assert storage.flush_segments(e, 10).count() == 0


def test_ranks_and_neighbours_across_ranges(spark):
    keys = [f"key_{i}" for i in range(1, 60)]
    rows = spark.createDataFrame([(k,) for k in reversed(keys)], "key string").repartition(7)
    assert {r.key: r.n for r in reads.ranked(rows, [nkey("key")], "n").collect()} == {k: i + 1 for i, k in enumerate(keys)}
    got = {r.key: (r.prev_key, r.next_key) for r in reads.neighbors(rows, width=5).collect()}
    assert got == {k: (keys[i - 1] if i else None, keys[i + 1] if i + 1 < len(keys) else None) for i, k in enumerate(keys)}
    assert reads.ranked(rows.limit(0), [nkey("key")], "n").count() == 0


def test_global_conflicts_across_ranges(spark):
    ops = spark.createDataFrame([(t, t * 10, f"k{t}", "W", "v") for t in range(1, 40)], "txn_id long, seq long, key string, op string, value string")
    txns = spark.createDataFrame([(t, t * 10 - 7 * (t % 5), t * 10 + 5, 3) for t in range(1, 40)], "txn_id long, begin_seq long, commit_seq long, lvl int")
    one = sorted(map(tuple, transactions.ww_conflicts_global(ops, txns).collect()))
    assert one and sorted(map(tuple, transactions.ww_conflicts_global(ops, txns, width=15).collect())) == one


def test_cache_ranges_agree_with_one_cache(spark):
    rng = random.Random(6)
    keys = [rng.randrange(1 + i // 8) for i in range(900)] + [7] * 300 + [rng.randrange(60) for _ in range(300)]
    rows = spark.createDataFrame([(i + 5, f"k{k}") for i, k in enumerate(keys)], "seq long, key string").where("seq not between 400 and 470")
    held, want = [], {}
    for r in rows.orderBy("seq").collect():
        want[r.seq] = r.key in held
        held = [k for k in held if k != r.key][-19:] + [r.key]
    for width in (16, 10_000):
        assert {r.seq: r.hit for r in storage.cache_sim(rows, 20, width).collect()} == want
    assert storage.cache_sim(rows.limit(0), 20).count() == 0


def test_gap_locks_of_long_lives_meet(spark):
    txns = spark.createDataFrame([(1, 0, 500), (2, 100, 130), (3, 499, 700), (4, 500, 520)], "txn_id long, begin_seq long, commit_seq long")
    gaps = spark.createDataFrame([(1, "b", "d"), (2, "d", "e"), (3, "a", "b"), (4, "b", "c")], "txn_id long, lo string, hi string")
    assert sorted(map(tuple, transactions.gap_conflicts(gaps, txns).collect())) == [(1, 2), (1, 3), (3, 4)]
    writes = spark.createDataFrame([(2, "c"), (4, "a"), (3, "z")], "txn_id long, key string")
    assert sorted(map(tuple, transactions.gap_blocked_writes(writes, gaps, txns).collect())) == [(2, "c", 1), (4, "a", 3)]


def test_commit_index_is_of_the_current_term(spark):
    log = spark.createDataFrame([(1, 1), (2, 2), (3, 2), (4, 4)], "index long, term long")
    acks = lambda *m: spark.createDataFrame([(f"n{i}", x) for i, x in enumerate(m)], "node string, match_index long")
    of = lambda a, term: replication.commit_index(a, log, term).first().commit_index
    assert of(acks(4, 3, 3, 1, 0), 2) == 3 and of(acks(4, 3, 3, 1, 0), 4) is None and of(acks(4, 4, 4, 1, 0), 4) == 4 and of(acks(4, 4, 1, 0), 2) is None
