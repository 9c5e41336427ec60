"""The other operators against brute force, exact round trips or held-out accuracy."""

import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import language_id, mixing, near_dedup, packing, queries, token_counts, tokens, topk_search
from tidelog.llm.common import stored


def slow_ids(text, tok=[]):
    if not tok:
        from tokenizers import Tokenizer

        tok.append(Tokenizer.from_file(tokens.default_path()))
        tok[0].encode_special_tokens = True
    return tok[0].encode(text or "", add_special_tokens=False).ids


def test_ids_are_those_of_tokenizers(spark, sf, odd):
    e = tokens.Encoder(tokens.default_path())
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [r.text for r in odd.collect()]
    texts += ["  \n\n a  b\t\tc's don't 12\u00b23 \u1fff\u3000x ", " " * 3000, "\x00\x01", "🙂🙂 e\u0301"]
    for t in texts:
        assert e.ids(t or "") == slow_ids(t)


def test_token_histogram(spark, sf, odd, none):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text").unionByName(odd.select("text"))
    n = sorted(len(slow_ids(r.text)) for r in docs.collect())
    h = token_counts.histogram(docs).cache()
    got = {r.length: r for r in token_counts.suffix_sums(h).collect()}
    assert sorted(got) == sorted(set(n))
    for k, r in got.items():
        assert r.n_docs == n.count(k) and r.docs_le == sum(x <= k for x in n) and r.tokens_gt == sum(x for x in n if x > k)
        assert r.truncated_total == sum(min(x, k) for x in n)
    for r in token_counts.totals(h, [0, 1, 100, 5000, 10**9]).collect():
        assert r.truncated_total == sum(min(x, r["limit"]) for x in n) and r.docs_gt == sum(x > r["limit"] for x in n)
    assert token_counts.quantile(h, 0.5).first().length == n[-(-len(n) // 2) - 1]
    assert token_counts.suffix_sums(token_counts.histogram(none)).count() == 0 and token_counts.quantile(token_counts.histogram(none), 0.5).count() == 0


def check_pack(rows, docs, limit=1024):
    bins, per = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
        per[r.doc_id, r.piece].append(r)
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= limit
    want = defaultdict(list)
    for d in docs:
        ids = np.array([*slow_ids(d.text), 2], np.uint32)
        n = len(ids)
        cuts = [0, n] if n <= limit else list(range(n % limit, n + 1, limit)) if n % limit == 0 else [0, *range(n % limit, n + 1, limit)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[d.doc_id, k].append((a, b - a, zlib.crc32(ids[a:b].tobytes())))
    assert {k: sorted((r.start, r.length, r.ids_crc32) for r in v) for k, v in per.items()} == {k: sorted(v) for k, v in want.items()}
    return len(bins)


def test_packing(spark, sf, odd, none):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    rows = packing.pack(docs, group=40).collect()
    used = check_pack(rows, docs.collect())
    bound = packing.lower_bound(np.array([r.length for r in rows]), 1024)
    whole = len(packing.best_fit(np.array([r.length for r in rows]), 1024)[2])
    assert bound <= used <= 1.02 * whole + 1  # groups as small as these leave a little
    assert len({r.sequence_id for r in packing.pack(docs).collect()}) == whole
    assert packing.pack(none).count() == 0


def test_bounds_and_best_fit():
    rng = np.random.default_rng(1)
    for _ in range(30):
        s = rng.integers(1, 101, rng.integers(1, 200))
        _, _, fill = packing.best_fit(s, 100)
        assert packing.lower_bound(s, 100) <= len(fill) and max(fill) <= 100 and sum(fill) == s.sum()
    assert packing.lower_bound(np.array([51] * 7), 100) == 7 and packing.lower_bound(np.array([34] * 6), 100) == 3


def brute_topk(rows, k=5):
    """Every row that is a query against every other row, in whole numbers."""
    rows = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, a) in enumerate(rows):
        if i is None or i % 50:
            continue
        found = [(sum(x * y for x, y in zip(a, b, strict=False)), j) for m, (j, b) in enumerate(rows) if m != n]
        found.sort(key=lambda r: (-r[0], r[1] is None, r[1] or 0))
        out += [(i, rank + 1, j, s) for rank, (s, j) in enumerate(found[:k])]
    return sorted(out, key=repr)


def test_topk(spark, sf):
    emb = spark.read.parquet(f"{sf}/embeddings.parquet")
    rng = np.random.default_rng(3)
    same = rng.normal(size=8).tolist()
    odd = [(None, same), (0, same), (0, same), (1, None), (2, [None, 1.0]), (3, [float("nan")] * 8), (4, [float("inf")] * 8), (5, []), (6, [1.0]), *[(i, same) for i in range(7, 30)], *[(i, rng.normal(size=8).tolist()) for i in range(30, 400)], (50, None), (7, same), (50, same), (None, [9.0] * 8)]
    small = spark.createDataFrame([(i, v, 1) for i, v in odd], "vec_id long, embedding array<double>, rank int")
    # scores far above 2^53 that differ in their last bits only
    wide = spark.createDataFrame([(0, [2.0**20, 2.0**20, 1 / 256]), *[(i, [2.0**20, 2.0**20 - (i % 7), i / 256]) for i in range(1, 300)]], "vec_id long, embedding array<double>")
    for df in (emb, small, wide):
        rows = [(r.vec_id, r.embedding) for r in df.collect()]
        v, _ = stored(topk_search.quantized(df), "vectors")
        got = sorted((tuple(r) for r in topk_search.topk(v, v.where("vec_id % 50 = 0"), 5, block=4, slice_rows=100).collect()), key=repr)
        assert got == brute_topk(rows)
    empty, _ = stored(topk_search.quantized(small.limit(0)), "vectors")
    assert topk_search.topk(empty, empty).count() == 0


def test_topk_beyond_64_bits(spark):
    far = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e300, 0.0]), (2, [1e300, 5.0]), (3, [-1e300, 0.0]), (4, [0.0, 2.0])], "vec_id long, embedding array<double>")
    v, _ = stored(topk_search.quantized(far), "vectors")
    top = 2**63 - 1
    assert [tuple(r)[2:] for r in topk_search.topk(v, v.where("vec_id = 0"), 5).orderBy("rank").collect()] == [(1, top), (2, top), (4, 512 * 256), (3, -(2**63))]


def test_branch_and_bound_prunes_exactly():
    rng = np.random.default_rng(5)
    q, c = np.floor(rng.normal(size=(7, 64)) * 256).astype(np.int64), np.floor(rng.normal(size=(3000, 64)) * 256 * np.linspace(3, 0.01, 64)).astype(np.int64)
    ids, work = rng.permutation(3000), []
    batches = ((np.arange(a, a + 100), ids[a : a + 100], np.zeros(100, bool), c[a : a + 100]) for a in range(0, 3000, 100))
    best = topk_search.branch_and_bound(q, np.arange(-7, 0), batches, 5, work)
    for k in range(7):
        want = sorted(zip(-(c @ q[k]), ids, strict=True))[:5]
        assert [(-x, y) for x, y in want] == list(zip(best.score[k], best.id[k], strict=True))
    assert 0 < sum(work) < 0.1 * 7 * 3000 * (64 - topk_search.DIMS)  # most pairs are cut before their last block


def test_language(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op7_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    model = language_id.fit(docs)
    out = language_id.predict(odd, model).collect()
    assert len(out) == odd.count() and all((r.lang_pred == "und") == (r.score == 0) for r in out)
    assert {r.lang_pred for r in out if r.doc_id in (1, 2, 4)} == {"und"}
    assert language_id.predict(none, model).count() == 0 and language_id.fit(none) is None
    assert {r.lang_pred for r in language_id.predict(odd, None).collect()} == {"und"}


def test_mixing(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got, error = mixing.mix(docs, labels)
    rows = got.collect()
    assert len(rows) == docs.count() and max(map(abs, error)) < 0.01 and min(r.rate for r in rows) >= 0
    n, p, r = (np.array([getattr(x, c) for x in rows], float) for c in ("tokens", "p", "rate"))
    want = np.array([mixing.TARGETS[d] for d in mixing.DOMAINS]) * n.sum()
    assert (r * n) @ p == pytest.approx(want, rel=0.01)
    truth = {x.doc_id: x.domain for x in mixing.labelled(docs, labels).collect()}
    hit = [mixing.DOMAINS[int(np.argmax(x.p))] == truth[x.doc_id] for x in rows if x.doc_id in truth]
    assert np.mean(hit) > 0.9
    for d, lab in ((odd, labels), (odd, labels.limit(0)), (none, labels)):
        m, _ = mixing.mix(d, lab)
        assert m.count() == d.count() and m.where("rate is null or rate < 0").count() == 0


def test_rates_are_a_least_squares_solution():
    rng = np.random.default_rng(1)
    # the last two cannot be met, so the end is only neared
    for share, near in (([0.9, 0.04, 0.06], 1e-4), ([0.7, 0.2, 0.1], 1e-4), ([0.5, 0.5, 0.0], 5e-3), ([1.0, 0.0, 0.0], 5e-3)):
        p = rng.dirichlet([4, 0.4, 0.4], 300)
        n = rng.integers(1, 900, 300)
        mass, share = p * n[:, None], np.array(share)
        r, error = mixing.projected_gradient(mass, share, tolerance=0.0)
        assert (r >= 0).all() and np.allclose(error, r @ mass / mass.sum() - share)
        g = p @ error  # at a minimum no allowed change lowers the squared error
        assert (g > -near).all() and np.abs(n * r * g).sum() / n.sum() < near
        # no random change of a solution, nor any single rate's best change, is better
        best = (error**2).sum()
        for _ in range(200):
            x = np.maximum(0, r + rng.normal(size=300) * 0.05)
            assert ((x @ mass / mass.sum() - share) ** 2).sum() >= best - near


def test_targets_out_of_reach_move_no_rates():
    rng = np.random.default_rng(2)
    low, toxic = rng.uniform(0, 3e-4, 2009), np.concatenate([rng.beta(1, 200, 2000), rng.beta(12, 1, 9)])  # next to nothing of the second
    p = np.stack([1 - low - toxic, low, toxic], axis=1).clip(1e-9)
    n = np.concatenate([rng.choice([90, 300, 5000], 2000), np.full(9, 900)])
    mass, share, total = p * n[:, None], np.array([0.97, 0.01, 0.02]), n.sum()
    bad = np.arange(2009) >= 2000
    loose, _ = mixing.projected_gradient(mass, share)
    for least, share in ((0.0, share), (np.where(bad, 0.0, 1.0), share * 1.03)):
        r, error = mixing.projected_gradient(mass, share, pull=mixing.PULL, least=least)
        assert (r >= least).all() and np.abs(r[~bad] - 1).max() < 0.5 and r[bad].min() > 1
        assert abs(error[2]) < 0.001 and error[1] < -0.0098 and n @ r < 1.04 * total
        # the optimum of the pulled squares: a step from it goes nowhere
        g = p @ error + mixing.PULL * (r - 1)
        assert np.abs(np.maximum(least, r - g) - r).max() < 1e-4
    assert loose.max() > r.max()  # without the pull, rates chase what is not there


def jaccard(a, b):
    a, b = (set(near_dedup.shingles(x, near_dedup._Hashes()).tolist()) for x in (a, b))
    return len(a & b) / len(a | b) if a or b else 0.0


def brute_groups(rows, threshold=0.8, counted=False):
    """The ids of each class; classes are of texts, so two of them may hold the same id."""
    texts = sorted({t for _, t in rows}, key=lambda t: (t is not None, t))
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    sets = {t: set(near_dedup.shingles(t, near_dedup._Hashes(), counted).tolist()) for t in texts}
    for i, a in enumerate(texts):
        for b in texts[:i]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small and small >= threshold * large and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    group = defaultdict(list)
    for d, t in rows:
        group[find(t)].append(d)
    return list(group.values())


def brute_classes(rows, threshold=0.8, counted=False):
    return sorted((d, min((x for x in g if x is not None), default=None)) for g in brute_groups(rows, threshold, counted) for d in g if d is not None)


def linked(spark, rows, **kw):
    """Root of every row of (uid, text) by the operator with small cells."""
    docs = spark.createDataFrame(rows, "uid long, text string").withColumn("k", F.col("uid"))
    root = {r.uid: r.root for r in near_dedup.linked(docs, docs.select("uid", "k"), **kw).collect()}
    return sorted((d, root.get(d, d)) for d, _ in rows)


def test_near_duplicates(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rng = np.random.default_rng(9)
    base = ["w%d" % i for i in rng.integers(0, 500, 150)]
    copies = []
    for i in range(120):  # a graded group: later copies differ more
        w = list(base)
        for j in rng.integers(0, len(w), i // 12):
            w[j] = f"x{i}_{j}"
        copies.append((100_000 + i, " ".join(w)))
    docs = docs.unionByName(spark.createDataFrame(copies, "doc_id long, text string")).unionByName(odd.select((F.col("doc_id") + 200_000).alias("doc_id"), "text").where("doc_id > 200004"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = near_dedup.classes(docs).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id, r.class_id) for r in got) == brute_classes(rows)
    one = near_dedup.one_of_each(docs)
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == sorted(map(min, brute_groups(rows)))
    out = near_dedup.classes(odd).collect()
    assert len(out) == odd.count() and near_dedup.classes(none).count() == 0 and near_dedup.one_of_each(none).count() == 0
    assert near_dedup.one_of_each(odd).where("doc_id = 3").count() == 1


def test_components_in_several_tasks(spark):
    rng = np.random.default_rng(8)
    pairs = [(int(x), int(y)) for x, y in rng.integers(0, 3000, (2000, 2))] + [(7000 + i, 7001 + i) for i in range(300)]
    links = spark.createDataFrame(pairs, "x long, y long")
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for x, y in pairs:
        a, b = find(x), find(y)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for x in root if find(x) != x}
    for a_task in (10, 10_000):
        got = near_dedup.components(links, len(pairs), a_task).collect()
        assert len(got) == len(want) and {r.uid: r.root for r in got} == want


def test_large_buckets_meet_again(spark):
    rng = np.random.default_rng(4)
    base = ["w%d" % i for i in rng.integers(0, 900, 200)]
    rows = [(i, " ".join([*base, f"end{i}"])) for i in range(90)] + [(1000 + i, " ".join(f"r{i}_{j}" for j in range(50))) for i in range(20)]
    assert linked(spark, rows, chunk=8) == brute_classes(rows)


def test_dart_signature_estimates_weighted_jaccard():
    rng = np.random.default_rng(2)
    e = rng.integers(0, 2**63, 300).astype(np.uint64)
    wa, wb = 1 + 3 * rng.random(300), 1 + 3 * rng.random(300)
    wb[:60] = wa[:60]
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    k = 4000
    s = near_dedup.dart_signature(np.concatenate([e, e]), np.concatenate([wa, wb]), np.repeat([0, 1], 300), 2, k)
    assert abs((s[0] == s[1]).mean() - want) < 0.03


def near_threshold(n, edits=3):
    """Copies of one text with random edits: with more of them, fewer pairs are above the threshold."""
    rng = np.random.default_rng(12)
    base = [f"w{i}" for i in rng.integers(0, 10_000, 200)]
    rows = []
    for i in range(n):
        w = list(base)
        for j in rng.integers(0, 200, edits):
            w[j] = f"x{i}_{j}"
        rows.append((i, " ".join(w)))
    return rows


def test_links_near_the_threshold_are_all_looked_at(spark):
    rows = near_threshold(500)
    got = near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == brute_classes(rows)


def repeated_texts():
    """Texts next to the same text written two, four and eight times."""
    return [(10 * g + k, " ".join(f"g{g}w{i}" for _ in range(times) for i in range(60))) for g in range(40) for k, times in enumerate((1, 2, 4, 8))]


def test_repeated_passages_do_not_hide_a_link(spark):
    rows = repeated_texts()
    got = near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == brute_classes(rows)


def chained(n):
    """A chain of texts, each linked only to the next few: links between cells are needed to join it."""
    words = [f"c{i}" for i in range(200 + 15 * n)]
    return [(i, " ".join(words[15 * i : 15 * i + 200])) for i in range(n)]


def test_links_between_cells_of_a_large_bucket_are_found(spark):
    rows = chained(30) + [(1000 + i, t) for i, t in near_threshold(120)]
    assert linked(spark, rows, chunk=8) == brute_classes(rows)


def test_repetitions_count_where_asked(spark):
    rows = repeated_texts() + near_threshold(60)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    got = near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string"), counted=True).collect()
    want = brute_classes(rows, counted=True)
    assert sorted((r.doc_id, r.class_id) for r in got) == want != brute_classes(rows)


def banded(level, n=150):
    """Pairs of 100 words at about one similarity, one side with a repeated line."""
    rng = np.random.default_rng(int(1000 * level))
    rows = []
    for g in range(n):
        w = [f"b{level}_{g}_{i}" for i in range(116)]
        v = list(w)
        for j in rng.choice(23, int(round((1 - level) / (1 + level) * 112 / 5)), replace=False):
            v[5 * j] = f"y{g}_{j}"
        rows += [(2 * g, " ".join(w)), (2 * g + 1, " ".join([*v, *(v[-16:] * (g % 3))]))]
    return rows


def test_recall_by_similarity(spark):
    rows, links = [], []
    for level in (0.82, 0.86, 0.9, 0.95):
        for a, b in zip(*[iter(banded(level))] * 2, strict=True):
            i = len(rows)
            rows += [(i, a[1]), (i + 1, b[1])]
            links.append((i, i + 1, jaccard(a[1], b[1])))
    root = dict(linked(spark, rows))
    for lo in (0.8, 0.84, 0.88, 0.92, 0.96):
        band = [(x, y) for x, y, j in links if lo <= j < lo + 0.04]
        assert not band or sum(root[x] == root[y] for x, y in band) >= 0.99 * len(band), lo
    assert all(root[x] != root[y] for x, y, j in links if j < 0.8)


def test_a_group_far_above_a_cell(spark):
    rows = near_threshold(1500, 5) + [(5000 + i, t) for i, t in near_threshold(40, 2)]
    assert linked(spark, rows, chunk=64) == brute_classes(rows)
