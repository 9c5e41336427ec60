"""The store, its command line and the binary formats against a plain dictionary."""

import random

import pytest

from tidelog.cli import Session, command
from tidelog.sources import codec, register
from tidelog.store import ConflictError, Store, StoreError


def test_store_against_a_dict(spark, tmp_path):
    rng, s, model, states = random.Random(1), Store(spark, str(tmp_path / "t")), {}, {}
    for _ in range(6):
        ops = []
        for _ in range(rng.randrange(1, 12)):
            k = f"key_{rng.randrange(1, 13)}"
            ops.append(("del", k, None) if rng.random() < 0.3 else ("put", k, str(rng.randrange(99))))
        v = s.batch(ops)
        for op, k, x in ops:
            model.pop(k, None) if op == "del" else model.__setitem__(k, x)
        states[v] = dict(model)
    assert v == sum(1 for _ in s.log().collect())
    for at, want in states.items():
        assert {r.key: r.value for r in s.scan("key_0", "key_99", at).collect()} == want
    natural = sorted(model, key=lambda k: int(k[4:]))
    assert [r.key for r in s.scan("key_0", "key_99").collect()] == natural and s.keys() == sorted(model)
    got, token = [], None
    while True:
        rows, token = s.page("key_0", "key_99", 3, token)
        got += [r.key for r in rows]
        if not token:
            break
    assert got == natural
    name, at = s.snapshot()
    s.put("key_1", "later")
    s.delete("key_2")
    s.compact()
    assert {r.key: r.value for r in s.scan("key_0", "key_99", at).collect()} == model
    s.release(name)
    s.compact()
    assert s.get("key_1") == "later" and s.get("key_2") is None and s.log().where("deleted").count() == 0
    assert s.vacuum() > 0 and s.get("key_1") == "later"
    assert s.multi_get(["key_1", "none", "key_1"]).select("found").collect() == [(True,), (False,), (True,)]


def test_transactions(spark, tmp_path):
    s = Store(spark, str(tmp_path / "t"))
    s.batch([("put", "a", "1"), ("put", "b", "1")])
    t, u = s.begin(), s.begin("READ_COMMITTED")
    t.put("a", "2")
    assert t.get("a") == "2" and u.get("a") == "1" and s.begin(0).get("a") == "2"
    with pytest.raises(StoreError):
        s.set_isolation(1)
    s.put("b", "9")
    assert t.get("b") == "1" and u.get("b") == "9"
    t.put("c", "3")
    assert [(r.key, r.value) for r in t.scan("a", "z").collect()] == [("a", "2"), ("b", "1"), ("c", "3")]
    s.put("a", "5")
    with pytest.raises(ConflictError):
        t.commit()
    with s.begin(4) as w:
        w.put("d", "1")
        w.put("d", "2")
    assert s.get("d") == "2" and s.get("c") is None and s.aborted == 1


def test_command_line(spark, tmp_path):
    s = Session(Store(spark, str(tmp_path / "t")))
    run = lambda x: command(s, x)
    assert run("put user:1 Alice") == "ok 1" and run("get user:1") == "Alice" and run("get x") == "(not found)"
    assert run("multiput key_2 b key_10 c key_1 a") == "ok 4"
    assert run("scan key_1 key_10") == "key_1 = a\nkey_2 = b\nkey_10 = c"
    assert run("multiget key_1 zz") == "key_1 = a\nzz = (not found)" and run("prefix user") == "user:1 = Alice"
    assert run("begin 4").endswith("SERIALIZABLE") and run("put q 1") == "ok" and run("commit").startswith("committed")
    assert run("setiso bogus") == "was SNAPSHOT_ISOLATION" and run("ping") == "pong" and "current_version: 5" in run("stats")
    assert run("put a") == "put takes 2 arguments" and run("rollback") == "no transaction" and run("nope").startswith("unknown") and run("exit") == "bye"


def test_codecs():
    rows = [(1, b"k%d" % i, b"v" * i) for i in range(20)]
    data = codec.write_log(rows)
    assert [(o, k, v) for _, _, o, k, v, ok in codec.read_log(data) if ok] == rows
    bad = bytearray(data)
    bad[8 + 13 + 2] ^= 1  # inside the second record's frame or the first one's value
    assert sum(ok for *_, ok in codec.read_log(bytes(bad))) == 19
    assert len(list(codec.read_log(data[:-1]))) == 19
    pairs = [(b"a", b"1"), (b"b", codec.TOMBSTONE)]
    assert [(k, v, d) for _, k, v, d in codec.read_sorted(codec.write_sorted(pairs))] == [(b"a", b"1", False), (b"b", codec.TOMBSTONE, True)]


def test_sources(spark, tmp_path):
    register(spark)
    wal = spark.createDataFrame([(1, f"k{i}", f"v{i}") for i in range(50)] + [(2, "k1", "")], "op int, key string, value string")
    wal.repartition(3).write.format("kvwal").mode("append").save(str(tmp_path / "wal"))
    back = spark.read.format("kvwal").load(str(tmp_path / "wal"))
    assert back.where("crc_ok").count() == 51 and back.where("op = 2").first().key == "k1"
    sst = spark.createDataFrame([("a", "1", False), ("b", None, True)], "key string, value string, deleted boolean")
    sst.coalesce(1).write.format("kvsst").mode("append").save(str(tmp_path / "sst"))
    assert [(r.key, r.value, r.deleted) for r in spark.read.format("kvsst").load(str(tmp_path / "sst")).collect()] == [("a", "1", False), ("b", None, True)]
