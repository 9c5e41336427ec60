"""The corpus pipeline, stage by stage, against brute force over whole texts; each stage on its own input."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_free import brute_classes, check_pack
from test_native import brute_quality, brute_secrets

import corpus_pipeline
from tidelog.llm import mixing, secret_scan, tokens

STAGE = dict(corpus_pipeline.STAGES)
ROWS = "doc_id long, text string, lang string, source string, n_chars long"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def docs(spark, sf, odd):
    """The smallest documents, copies of some under new, repeated and null ids, and odd texts."""
    base = spark.read.parquet(f"{sf}/documents.parquet")
    again = base.where("doc_id % 17 = 0")
    more = again.withColumn("doc_id", F.col("doc_id") + 1_000_000).unionByName(again).unionByName(again.withColumn("doc_id", F.lit(None).cast("long")))
    extra = odd.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
    return base.unionByName(more).unionByName(extra).select(*base.columns)


def kept_by_rules(t):
    n, chars, symbols, dup, repeat = brute_quality(t)
    lines = sum(bool(x.strip("\x20\x09\x0a\x0b\x0c\x0d")) for x in (t or "").split("\n"))
    return not (n < 50 or 100 * repeat > 50 * n or 100 * symbols > 30 * n or 100 * dup > 50 * lines or chars > 15 * n or chars < 2 * n)


def test_quality_stage(spark, sf, docs):
    got = STAGE["quality rules"](spark, docs, sf)
    assert got.columns == docs.columns
    at = docs.columns.index("text")
    assert rows(got) == [r for r in rows(docs) if kept_by_rules(r[at])]


def test_near_duplicate_stage(spark, sf, docs):
    got = STAGE["near duplicates"](spark, docs, sf)
    assert got.columns == docs.columns
    named = docs.where("doc_id > 10")
    pairs = [(r.doc_id, r.text) for r in named.collect()]
    one = [r.doc_id for r in STAGE["near duplicates"](spark, named, sf).collect()]
    assert sorted(one) == sorted({c for _, c in brute_classes(pairs)})
    assert not Counter(rows(got)) - Counter(rows(docs))


def brute_redact(t, model):
    if t is None:
        return None
    n, at = len(secret_scan.ALPHABET) + 1, secret_scan.ALPHABET
    code = lambda c: at.index(c) if c in at else n - 1
    import re

    base = [(a, e) for a, _, e in brute_secrets(t)]
    spans = list(base)
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", t):
        g = m[0]
        v = sum(round(model[code(a) * n + code(b)], 6) for a, b in zip(g, g[1:], strict=False)) / (len(g) - 1)
        if v > 0.4 and not any(a < m.end() and m.start() < e for a, e in base):
            spans.append((m.start(), m.end()))
    out, pos = "", 0
    for a, e in sorted(spans):
        if a >= pos:
            out += t[pos:a] + "<SECRET>"
        pos = max(pos, e)
    return out + t[pos:]


def test_secret_stage(spark, sf, docs):
    got = STAGE["secret scans"](spark, docs, sf)
    assert got.columns == docs.columns
    model = secret_scan.train(secret_scan.default_samples(spark))
    want = []
    for r in docs.collect():
        t = brute_redact(r.text, model)
        want.append(tuple({**r.asDict(), "text": t, "n_chars": None if t is None else len(t)}[c] for c in docs.columns))
    assert rows(got) == sorted(want, key=repr)
    assert any("<SECRET>" in (r[docs.columns.index("text")] or "") for r in want)


def test_mixing_stage(spark, sf, docs):
    got = STAGE["mixing to targets"](spark, docs, sf)
    assert got.columns == docs.columns
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = mixing.fit_classifier(docs, labels)
    p = {t: model.posterior((t or "").lower().split()) for t in {r.text for r in docs.collect()}}
    at = docs.columns.index("text")
    before, after = Counter(rows(docs)), Counter(rows(got))
    clean = {r for r in before if p[r[at]][0] >= 0.5}
    assert set(after) <= set(before) and clean <= set(after)
    assert all(after[r] >= before[r] for r in clean)
    ids = {t: len(tokens.encoder(tokens.default_path()).ids(t or "")) for t in p}
    share = sum(n * ids[r[at]] * p[r[at]] for r, n in after.items())
    share = share / share.sum()
    want = np.array([corpus_pipeline.TARGETS[d] for d in mixing.DOMAINS])
    start = sum(n * ids[r[at]] * p[r[at]] for r, n in before.items())
    assert np.abs(share - want).sum() <= np.abs(start / start.sum() - want).sum() + 1e-9
    assert np.abs(share - want).max() < 0.03  # whole copies of few documents, and one of each clean one at least


def test_whole_pipeline(spark, sf):
    out = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = spark.createDataFrame(stage(spark, out, sf).collect(), out.schema)
    packed = corpus_pipeline.run(spark, sf).collect()
    once = out.dropDuplicates(["doc_id"]).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in once}
    copies = Counter(r.doc_id for r in out.collect())
    pieces = Counter((r.doc_id, r.piece) for r in packed)
    assert all(n == copies[d] for (d, _), n in pieces.items())
    by = {}
    for r in packed:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in by.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 1024


def test_pack_stage(spark, sf, docs):
    check_pack(STAGE["best-fit packing"](spark, docs.dropDuplicates(["doc_id", "text"]).where("doc_id > 10"), sf).collect(), docs.dropDuplicates(["doc_id", "text"]).where("doc_id > 10").collect())


def test_empty_tables(spark, sf, none):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0, name


def test_clashing_columns(spark, sf, odd):
    clash = odd.withColumns({c: F.lit(1) for c in ("_d", "tokens", "p", "rate", "n", "key", "uid", "bands")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, clash, sf)
        assert got.columns == clash.columns
        got.collect()
    assert STAGE["mixing to targets"](spark, clash, sf).where("doc_id is null").count() >= 1
