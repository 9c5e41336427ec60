"""Near-duplicate classes by DartMinHash.

A text is a weighted set of five-word shingles: weight 1 each, or with ``counted`` how often the text
holds it (each repetition is a unit of weight of its own). Sketches, candidates and links all go by the
Jaccard similarity of these same weights. Darts are thrown at the elements' weight regions: per unit of
weight they arrive as a Poisson process whose gaps come from a hash, so equal regions get equal darts in
every document. Per coordinate the earliest dart is kept; a document needs about k ln k darts whatever
its length. Bands of the signature name buckets.

Every pair that shares a bucket is settled: its exact similarity is computed, or both rows are already in
one class. Rows that buckets join, directly or not, are a group. A group of bounded size is one cell,
where all pairs are compared. Rows of a larger group first meet two random parts of their largest bucket;
then the rows outside the commonest class are compared with all others, in the group or in each bucket,
whichever is less work, in cells of two half chunks. So the work beyond a cell is quadratic only in rows
that have no link.

Defined results: exact copies (equal texts) share a class whatever their length; null text is its own
text, equal to other nulls; texts without a word link only to equal ones; texts of fewer than five
words are one shingle; repeated and null ids are kept, one result row per input row; a class is named by
its smallest id that is not null (null if it has none); an empty table gives no rows; extra columns are
never read by ``classes``, and decide between rows of one id and text in ``one_of_each``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROWS_A_TASK, drop, stored

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 4
K = BANDS * ROWS
#: Rows of a cell: every pair of a cell is compared by one task.
CHUNK = 256
#: A text of more distinct shingles than this counts as several rows of a cell.
HEAVY = 2048
_M = np.uint64(0x9E3779B97F4A7C15)
_words = re.compile(r"\w+").findall


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, w: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        got = self[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        return got


def shingles(text: str | None, memo: dict[str, int], counted: bool = False) -> np.ndarray:
    """Sorted distinct 64-bit shingles; with ``counted`` the k-th repetition of one is an element of its own."""
    words = _words((text or "").lower())
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - WORDS + 1)
    s = np.zeros(n, np.uint64)
    for j in range(min(WORDS, len(h))):
        s = _mix(s + h[j : j + n] + _M)
    if not counted:
        return np.unique(s)
    s.sort()
    turn = np.arange(n) - np.searchsorted(s, s)
    return np.unique(np.where(turn > 0, _mix(s + turn.astype(np.uint64) * _M), s))


def dart_signature(elements: np.ndarray, weights: np.ndarray, doc: np.ndarray, docs: int, k: int = K) -> np.ndarray:
    """k earliest darts per document (docs x k, uint64); flat elements, doc says whose they are.

    Documents with a coordinate left empty throw again over twice the time.
    """
    sig = np.zeros((docs, k), np.uint64)
    total = np.bincount(doc, weights, docs)
    time = np.full(docs, k * (np.log(k) + 2.0))
    todo = total > 0
    while todo.any():
        pick = todo[doc]
        e, w, d = elements[pick], weights[pick], doc[pick]
        reach = (time / np.maximum(total, 1e-300))[d]
        cells = np.ceil(w).astype(np.int64)
        e, w, d, reach = np.repeat(e, cells), np.repeat(w, cells), np.repeat(d, cells), np.repeat(reach, cells)
        cell = np.arange(len(e)) - np.repeat(np.cumsum(cells) - cells, cells)
        state = _mix(e + _M * (cell.astype(np.uint64) + np.uint64(1)))
        at = np.zeros(len(e))
        found_d, found_j, found_t, found_v = [], [], [], []
        while len(state):
            state = _mix(state + _M)
            at = at - np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            live = at <= reach
            state, at, reach, d, w, cell = state[live], at[live], reach[live], d[live], w[live], cell[live]
            if not len(state):
                break
            value = _mix(state ^ np.uint64(0xD1B54A32D192ED03))
            inside = cell + (value >> np.uint64(11)).astype(np.float64) * 2.0**-53 < w
            found_d.append(d[inside])
            found_j.append((_mix(value + _M) % np.uint64(k)).astype(np.int64)[inside])
            found_t.append(at[inside])
            found_v.append(value[inside])
        fd, fj, ft, fv = (np.concatenate(x) if x else np.empty(0) for x in (found_d, found_j, found_t, found_v))
        slot = fd.astype(np.int64) * k + fj.astype(np.int64)
        o = np.lexsort((ft, slot))
        slot, fv = slot[o], fv[o].astype(np.uint64)
        lead = np.concatenate(([True], slot[1:] != slot[:-1])) if len(slot) else np.empty(0, bool)
        have = np.bincount(slot[lead] // k, minlength=docs)[:docs] if len(slot) else np.zeros(docs, int)
        full = todo & (have == k)
        ok = full[slot[lead] // k] if len(slot) else np.empty(0, bool)
        sig.reshape(-1)[slot[lead][ok]] = fv[lead][ok]
        todo &= ~full
        time[todo] *= 2
    return sig


def _sets(batches: Iterator[pa.RecordBatch], counted: bool, once: bool) -> Iterator[tuple[list[tuple], list[np.ndarray]]]:
    """Runs of (other columns, shingle sets) of bounded size, of rows (key, text, ...) that have a word.

    With ``once`` a key that the task has just seen is passed over.
    """
    memo, seen = _Hashes(), set()
    other, sets, size = [], [], 0
    for b in batches:
        rest = zip(*(b.column(i).to_pylist() for i in range(b.num_columns) if i != 1), strict=True)
        for row, t in zip(rest, b.column(1), strict=True):
            if once:
                if row[0] in seen:
                    continue
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(row[0])
            s = shingles(t.as_py(), memo, counted)
            if len(s):
                other.append(row)
                sets.append(s)
                size += len(s) + 4 * K  # the darts of a text are many, however short it is
            if size >= 200_000:
                yield other, sets
                other, sets, size = [], [], 0
    if other:
        yield other, sets


def sketches(texts: DataFrame, counted: bool = False) -> DataFrame:
    """(uid, size, bands array<long>) of (uid, text) rows that have a word; copies in one task once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, sets in _sets(batches, counted, True):
            size = [len(s) for s in sets]
            doc = np.repeat(np.arange(len(sets)), size)
            sig = dart_signature(np.concatenate(sets), np.ones(len(doc)), doc, len(sets))
            band = np.zeros((len(sets), BANDS), np.uint64)
            for r in range(ROWS):
                band = _mix(band + sig[:, r::ROWS] + _M)
            band = (band + np.arange(BANDS, dtype=np.uint64) * _M).view(np.int64)
            yield pa.record_batch([pa.array([r[0] for r in row], pa.int64()), pa.array(size, pa.int32()), pa.array(list(band), pa.list_(pa.int64()))], ["uid", "size", "bands"])

    return texts.mapInArrow(run, "uid long, size int, bands array<long>")


def shingle_sets(texts: DataFrame, counted: bool = False) -> DataFrame:
    """(uid, cells, big, shingles binary) of rows (uid, text, cells, big)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, sets in _sets(batches, counted, False):
            uid, cells, big = zip(*row, strict=True)
            yield pa.record_batch(
                [pa.array(uid, pa.int64()), pa.array(cells, pa.list_(pa.int64())), pa.array(big, pa.bool_()), pa.array([s.tobytes() for s in sets], pa.binary())],
                ["uid", "cells", "big", "shingles"],
            )

    return texts.mapInArrow(run, "uid long, cells array<long>, big boolean, shingles binary")


def similar(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sorted sets reach the threshold, as a square of booleans; every pair by its exact similarity."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    if n == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return np.full((2, 2), both / (size.sum() - both) >= threshold)
    value, count = np.unique(np.concatenate(sets), return_counts=True)
    keep = count > 1  # a shingle of one row is in no intersection
    value, count = value[keep], count[keep]
    both = np.zeros((n, n), np.float32)
    if len(value):
        o = np.argsort(-count, kind="stable")
        place = np.empty(len(o), np.int64)
        place[o] = np.arange(len(o))
        cols = []
        for s in sets:
            at = np.minimum(np.searchsorted(value, s), len(value) - 1)
            cols.append(place[at[value[at] == s]])
        row = np.repeat(np.arange(n), [len(c) for c in cols])
        col = np.concatenate(cols)
        o = np.lexsort((row, col))
        row, col = row[o], col[o]
        dense = int((count >= max(4, n // 32)).sum())
        for lo in range(0, dense, 4096):
            hi = min(dense, lo + 4096)
            i, j = np.searchsorted(col, [lo, hi])
            block = np.zeros((n, hi - lo), np.float32)
            block[row[i:j], col[i:j] - lo] = 1
            both += block @ block.T
        row, col = row[np.searchsorted(col, dense) :], col[np.searchsorted(col, dense) :]
        flat = both.reshape(-1)
        gap = 1
        while gap < len(row):  # rows of one rare shingle follow one another: pairs by their distance
            same = np.nonzero(col[gap:] == col[:-gap])[0]
            if not len(same):
                break
            pair, times = np.unique(row[same] * n + row[same + gap], return_counts=True)
            flat[pair] += times
            x, y = pair // n, pair % n
            both[y, x] += times
            gap += 1
    both = both.astype(np.float64)
    return both / (size[:, None] + size[None, :] - both) >= threshold


def smallest_joined(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Of each of n nodes the smallest that the edges a - b join it to."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        if (new == root).all():
            return root
        while not (root == new).all():  # each to its root's root, until all are roots
            root, new = new, new[new]


def cell_links(label: np.ndarray, sets: list[np.ndarray], threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """(x, y): each label y of a cell that verified links join to a smaller one, and the smallest, x, that it is joined to."""
    names, of = np.unique(label, return_inverse=True)
    a, b = np.nonzero(np.triu(similar(sets, threshold), 1))
    root = smallest_joined(of[a], of[b], len(names))
    far = np.nonzero(root != np.arange(len(names)))[0]
    return names[root[far]], names[far]


def compared(cells: DataFrame, threshold: float) -> DataFrame:
    """Links (x, y, big) between labels of the rows (c, label, big, shingles) of each cell c, by exact similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, rows, now, flag = [], [], None, False

        def done() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            x, y = cell_links(np.array(label, np.int64), rows, threshold)
            return x, y, np.full(len(x), flag)

        def record(found: list) -> pa.RecordBatch:
            cols = [np.concatenate(v) for v in zip(*found, strict=True)] if found else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)]
            return pa.record_batch([pa.array(v) for v in cols], ["x", "y", "big"])

        for batch in batches:
            found, s = [], batch.column(3)
            for i, (c, u, f) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)):
                if c != now and len(rows) > 1:
                    found.append(done())
                if c != now:
                    label, rows, now, flag = [], [], c, f
                label.append(u)
                rows.append(np.frombuffer(s[i].as_buffer(), np.uint64).copy())
            yield record(found)
        if len(rows) > 1:
            yield record([done()])

    return cells.select("c", "label", "big", "shingles").repartition("c").sortWithinPartitions("c", "label").mapInArrow(run, "x long, y long, big boolean")


def _joined_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges (x, y) become one per row: (smallest row that they join it to, row, is it new)."""
    got = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
    x, y = (np.concatenate([g[i] for g in got]) if got else np.empty(0, np.int64) for i in (0, 1))
    names, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b = at[: len(x)], at[len(x) :]
    root = smallest_joined(a, b, len(names))
    new = np.ones(len(names), bool)
    new[b[a == root[b]]] = False
    far = np.nonzero(root != np.arange(len(names)))[0]
    yield pa.record_batch([pa.array(names[root[far]]), pa.array(names[far]), pa.array(new[far])], ["x", "y", "f"])


def components(links: DataFrame, rows: int, a_task: int = ROWS_A_TASK) -> DataFrame:
    """(uid, root), a written table: every row of ``links`` (x, y) but the roots, and the smallest id of its component.

    Links are dealt by their larger end to tasks of about ``a_task`` of ``rows``, the number of links at most;
    each task joins what it holds, until no task finds anything new. Then every row takes its parent's parent.
    No round holds more links than the one before; every round is written to the shared folder.
    """
    spark, tasks = links.sparkSession, -(-rows // a_task) or 1
    edges, path = links.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")), None
    kind = "x long, y long, f boolean"
    while True:
        dealt = edges.coalesce(1) if tasks == 1 else edges.repartition("y").coalesce(tasks)
        nxt, next_path = stored(dealt.mapInArrow(_joined_here, kind), "edges")
        if path:
            drop(spark, path)
        edges, path = nxt.select("x", "y"), next_path
        if tasks == 1:  # all of it was in one task
            return edges.select(F.col("y").alias("uid"), F.col("x").alias("root"))
        if nxt.where("f").isEmpty():
            break
    edges, next_path = stored(edges.groupBy("y").agg(F.min("x").alias("x")).select("x", "y"), "edges", rows)
    drop(spark, path)
    path = next_path
    while True:
        up = edges.select("x").distinct().join(edges.select(F.col("y").alias("x"), F.col("x").alias("up")), "x")
        up, up_path = stored(up, "parents", rows)
        if up.isEmpty():
            drop(spark, up_path)
            return edges.select(F.col("y").alias("uid"), F.col("x").alias("root"))
        nxt, next_path = stored(edges.join(up, "x", "left").select(F.coalesce("up", "x").alias("x"), "y"), "edges", rows)
        drop(spark, path, up_path)
        edges, path = nxt, next_path


def _roots(uids: DataFrame, comp: DataFrame, name: str = "root") -> DataFrame:
    return uids.join(comp, "uid", "left").withColumn("root", F.coalesce("root", "uid")).withColumnRenamed("root", name)


def left_over(m: DataFrame, shared: DataFrame, rows: int, chunk: int) -> DataFrame:
    """Cells (c, uid, label) that settle what is open among rows m (uid, g, w, label) of large groups.

    ``rows`` are those of ``shared``. A unit is a group or a bucket. Rows outside a unit's commonest label are parts 0 .. q - 1, the others the
    parts q .. q + p - 1; each part of the first kind meets every other part.
    """
    few = lambda df: df.coalesce(-(-rows // ROWS_A_TASK) or 1)
    one = m.select(F.col("g").alias("unit"), "g", "uid", "label", "w", F.lit(True).alias("whole"))
    each = few(shared.select("uid", "b").join(m, "uid")).select(F.xxhash64("b").alias("unit"), "g", "uid", "label", "w", F.lit(False).alias("whole"))
    units = one.unionByName(each)
    sums = few(units.groupBy("whole", "unit", "g", "label").agg(F.sum("w").alias("w"))).groupBy("whole", "unit", "g")
    sums = few(sums.agg(F.max(F.struct("w", "label")).alias("top"), F.sum("w").alias("load")).where("load > top.w"))
    cost = sums.groupBy("g").agg(*[F.coalesce(F.sum(F.when(F.col("whole") == v, (F.col("load") - F.col("top.w")) * F.col("load"))), F.lit(0.0)).alias(n) for n, v in (("as_group", True), ("as_buckets", False))])
    sums = few(sums.join(few(cost).select("g", (F.col("as_group") <= F.col("as_buckets")).alias("whole")), ["g", "whole"]))
    half = chunk / 2
    q, p = F.ceil((F.col("load") - F.col("top.w")) / half).cast("long"), F.ceil(F.col("top.w") / half).cast("long")
    u = few(units.join(sums.select("whole", "unit", F.col("top.label").alias("common"), q.alias("q"), p.alias("p")), ["whole", "unit"]))
    u = u.withColumn("part", F.when(F.col("label") == F.col("common"), F.col("q") + F.pmod(F.xxhash64("uid", "unit"), F.col("p"))).otherwise(F.pmod(F.xxhash64("uid", "unit"), F.col("q"))))
    others = F.when(F.col("part") < F.col("q"), F.col("q") + F.col("p")).otherwise(F.col("q"))
    u = u.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), others - 1)))
    return u.select("uid", "label", F.xxhash64("unit", F.least("part", "o"), F.greatest("part", "o")).alias("c"))


def linked(texts: DataFrame, first: DataFrame, chunk: int = CHUNK, threshold: float = THRESHOLD, counted: bool = False) -> DataFrame:
    """(uid, root), a written table: rows that links join to a smaller one, and the smallest of their class.

    ``texts`` holds rows (k, uid, text), ``first`` one key k per uid: copies of a text are passed by before
    texts are moved.
    """
    spark = texts.sparkSession
    temp: list[str] = []

    def kept(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        out, path = stored(df, name, rows)
        temp.append(path)
        return out

    sk = kept(sketches(texts.select("uid", "text"), counted).dropDuplicates(["uid"]), "sketches")
    members = sk.select("uid", F.greatest(F.lit(1.0), F.col("size") / HEAVY).alias("w"), F.explode("bands").alias("b"))
    sizes = members.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.min("uid").alias("x")).where("n > 1")
    shared = kept(members.join(sizes, "b"), "shared", BANDS * sk.count())
    n = shared.count()
    used = kept(
        shared.groupBy("uid").agg(F.first("w").alias("w"), F.collect_set("x").alias("xs"), F.max(F.struct("n", "b")).alias("home"))  # at most BANDS
        .select("uid", "w", F.col("home.b").alias("b"), "xs", F.array_min("xs").alias("m")), "used", n,
    )
    stars = used.select(F.col("m").alias("x"), F.explode(F.array_union("xs", F.array("uid"))).alias("y")).where("x <> y")
    group = _roots(used.select("uid", "w", "b"), components(stars, n), "g")
    load = group.groupBy("g").agg(F.sum("w").alias("load"))
    group = kept(group.join(load, "g").withColumn("big", F.col("load") > chunk), "groups", n)
    homes = group.where("big").groupBy("b").agg(F.ceil(F.sum("w") / chunk).cast("long").alias("parts"))
    deal = lambda turn: F.xxhash64("b", F.lit(turn), F.pmod(F.xxhash64("uid", F.lit(turn)), F.col("parts")))
    cells = F.when(F.col("parts") > 1, F.array(deal(0), deal(1))).when(F.col("parts") == 1, F.array(deal(0))).otherwise(F.array("g"))
    dealt = group.join(homes, "b", "left").select("uid", cells.alias("cells"), "big")
    keys = dealt.join(first, "uid").select("k", "cells", "big")
    # the used texts grow with the corpus: the same shuffled join at every size
    sets = kept(shingle_sets(texts.join(keys.hint("merge"), "k").select("uid", "text", "cells", "big"), counted).dropDuplicates(["uid"]), "sets")
    rows = sets.select(F.explode("cells").alias("c"), F.col("uid").alias("label"), "big", "shingles")
    links = kept(compared(rows, threshold), "links")
    done = links.where("not big").select(F.col("y").alias("uid"), F.col("x").alias("root"))
    rest = group.where("big").select("uid", "g", "w")
    if rest.isEmpty():
        out = done
    else:
        label = kept(_roots(rest, components(links.where("big").select("x", "y"), n), "label"), "label", n)
        cells = left_over(label, shared, n, chunk)
        rows = cells.join(sets.where("big").select("uid", "shingles"), "uid").select("c", "label", F.lit(True).alias("big"), "shingles")
        more = components(kept(compared(rows, threshold).select("x", "y"), "links"), n).select(F.col("uid").alias("label"), "root")
        big = label.join(more, "label", "left").select("uid", F.coalesce("root", "label").alias("root"))
        out = done.unionByName(big.where("uid <> root"))
    out, _ = stored(out, "roots", n)
    drop(spark, *temp)
    return out


def _uid(text: str) -> Column:
    return F.xxhash64(F.col(text).cast("string"))


def _found(docs: DataFrame, threshold: float, text: str, id_col: str, others: list[str], counted: bool) -> tuple[DataFrame, DataFrame]:
    """Written table of rows (doc_id, uid, k), and rows (uid, root, m) per text: m its first row as (no id, id, k)."""
    # rows that agree in id, text and ``others`` are equal and share k
    k = F.xxhash64(F.col(id_col).cast("long"), _uid(text), *([F.to_json(F.struct(*[F.col(f"`{c}`") for c in others]))] if others else []))
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), _uid(text).alias("uid"), k.alias("k"), F.col(text).cast("string").alias("text"))
    rows, _ = stored(keyed.select("doc_id", "uid", "k"), "ids")
    first = rows.groupBy("uid").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k")).alias("m"))
    root = linked(keyed.select("k", "uid", "text"), first.select("uid", "m.k"), threshold=threshold, counted=counted)
    return rows, _roots(first, root)


def classes(docs: DataFrame, threshold: float = THRESHOLD, text: str = "text", id_col: str = "doc_id", counted: bool = False) -> DataFrame:
    """One row per input row: id and class_id, the smallest id of its class."""
    rows, per_text = _found(docs, threshold, text, id_col, [], counted)
    per_text, _ = stored(per_text.select("uid", "root", F.col("m.doc_id").alias("first")), "texts")
    lead = per_text.groupBy("root").agg(F.min("first").alias("class_id"))
    return rows.join(per_text.join(lead, "root").select("uid", "class_id"), "uid").select("doc_id", "class_id")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, text: str = "text", id_col: str = "doc_id", counted: bool = False) -> DataFrame:
    """``docs`` with one row of each class, that of the smallest id (null ids come last), and its own columns.

    Of rows of one id and text, a hash of the other columns decides.
    """
    others = [c for c in docs.columns if c not in (text, id_col)]
    _, per_text = _found(docs, threshold, text, id_col, others, counted)
    lead = per_text.groupBy("root").agg(F.min("m").alias("m")).select(F.col("m.k").alias("_k"))
    k = F.xxhash64(F.col(id_col).cast("long"), _uid(text), *([F.to_json(F.struct(*[F.col(f"`{c}`") for c in others]))] if others else []))
    return docs.withColumn("_k", k).join(lead, "_k", "left_semi").dropDuplicates(["_k"]).select(*docs.columns)
