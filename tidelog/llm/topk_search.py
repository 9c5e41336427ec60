"""Exact top-k by inner product: columnar branch-and-bound.

Candidates lie in vertical layout (one row per dimension). Dimensions are ordered by energy and taken
block by block; after each block, Cauchy-Schwarz on the remaining mass bounds what a candidate can
still gain, and only pairs that can reach the query's current k-th score are carried on. Bounds only
skip work, so results are exact.

Queries are dealt to blocks and candidates to slices; every block meets every slice in a cell of its
own, all in one plan. A task holds the queries of one cell and one batch of candidates, and keeps k
rows per query.

Defined results: vectors that are null or hold null or non-finite components take no part; every row is
a candidate, also one whose id is null or repeated, except for the query that is the same row; of equal
scores the smaller id comes first, null ids last; shorter vectors count as padded with zeros; components
and scores beyond 64 bits are cut to the largest (smallest) 64-bit number before scores are ranked; an
empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK, SLICE, DIMS, CHUNK = 4096, 4096, 16, 1024
FOUND = "query_row long, query_id long, vec_id long, score long"
LONG = np.iinfo(np.int64)


def quantized(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(row, vec_id, v array<long>): floor(scale * x) of every valid vector; ``row`` names the row once it is written."""
    v = F.col(vector)
    ok = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(ok).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def matrix(lists: pa.Array, width: int = 0) -> np.ndarray:
    """Integer rows of a list array, padded with zeros to the longest or to ``width``."""
    size = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), max(width, size.max(initial=0))), np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == out.size:
        return flat.reshape(out.shape).astype(np.int64)
    row = np.repeat(np.arange(len(lists)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


class Best:
    """The k best (score, id) of every query so far."""

    def __init__(self, queries: int, k: int):
        self.score, self.id = np.full((queries, k), LONG.min), np.full((queries, k), LONG.max)
        self.none, self.full = np.zeros((queries, k), bool), np.zeros((queries, k), bool)
        self.k = k

    def limit(self) -> np.ndarray:
        """What a score has to reach, a little below the k-th best, as a float."""
        at = self.score[:, -1].astype(np.float64)
        return np.where(self.full[:, -1], at - np.abs(at) * 2.0**-50, -np.inf)

    def add(self, q: np.ndarray, score: np.ndarray, id_: np.ndarray, none: np.ndarray) -> None:
        n, k = self.score.shape
        old = np.nonzero(self.full)
        q, score = np.concatenate([old[0], q]), np.concatenate([self.score[old], score])
        id_, none = np.concatenate([self.id[old], id_]), np.concatenate([self.none[old], none])
        o = np.lexsort((id_, none, ~score, q))
        q, score, id_, none = q[o], score[o], id_[o], none[o]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        top = rank < k
        at = q[top], rank[top]
        self.score[at], self.id[at], self.none[at], self.full[at] = score[top], id_[top], none[top], True


def _pairs(q: np.ndarray, c: np.ndarray, limit: np.ndarray, own: np.ndarray, k: int, work: list[int] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, exact score) of every pair that may be among the k best."""
    w = max(q.shape[1], c.shape[1])
    qf, cf = np.zeros((len(q), w)), np.zeros((w, len(c)))
    qf[:, : q.shape[1]], cf[: c.shape[1]] = q, c.T  # vertical: a row per dimension
    if np.abs(qf).max(initial=1) * np.abs(cf).max(initial=1) * w >= 2.0**53:
        # floats with their error bound choose the pairs, whole numbers score them
        s = qf @ cf
        s[own] = -np.inf
        slack = (w + 4) * 2.0**-51 * np.sqrt((qf**2).sum(axis=1))[:, None] * np.sqrt((cf**2).sum(axis=0))[None, :]
        if len(c) > k:
            low = s - slack
            limit = np.maximum(limit, np.partition(low, len(c) - k, axis=1)[:, len(c) - k])
        rows, cols = np.nonzero((s + slack >= limit[:, None]) & ~own)
        exact = [sum(a * b for a, b in zip(q[i].tolist(), c[j].tolist(), strict=False)) for i, j in zip(rows, cols, strict=True)]
        return rows, cols, np.array([min(max(x, LONG.min), LONG.max) for x in exact], np.int64)
    order = np.argsort(-(np.abs(qf).mean(axis=0) * np.abs(cf).mean(axis=1))) if len(q) and len(c) else np.arange(w)
    qf, cf = np.ascontiguousarray(qf[:, order]), cf[order]
    cuts = [*range(0, w, DIMS), w] if w else [0, 0]
    part = qf[:, : cuts[1]] @ cf[: cuts[1]]
    rows = cols = None
    for done, nxt in zip(cuts[1:], [*cuts[2:], None], strict=True):
        rq, rc = np.sqrt((qf[:, done:] ** 2).sum(axis=1)), np.sqrt((cf[done:] ** 2).sum(axis=0))
        if rows is None:  # still dense: one bound for every pair
            keep = (part + rq[:, None] * rc[None, :] * (1 + 1e-9) + 1e-6 >= limit[:, None]) & ~own
            if nxt is not None and keep.mean() >= 0.25:
                part += qf[:, done:nxt] @ cf[done:nxt]
                continue
            rows, cols = np.nonzero(keep)
            part = part[rows, cols]
        else:
            keep = part + rq[rows] * rc[cols] * (1 + 1e-9) + 1e-6 >= limit[rows]
            rows, cols, part = rows[keep], cols[keep], part[keep]
        if nxt is not None:
            if work is not None:
                work.append(len(rows) * (nxt - done))
            for d in range(done, nxt):
                part = part + qf[rows, d] * cf[d, cols]
    return rows, cols, part.astype(np.int64)


def branch_and_bound(q: np.ndarray, q_row: np.ndarray, batches: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], k: int, work: list[int] | None = None) -> Best:
    """The k best of all candidates (row, id, id is null, integer vectors) for each query.

    ``work`` gathers how many products of single components the compacted pairs took.
    """
    best = Best(len(q), k)
    for row, id_, none, c in batches:
        r, col, score = _pairs(q, c, best.limit(), q_row[:, None] == row[None, :], k, work)
        best.add(r, score, id_[col], none[col])
    return best


def topk(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK, slice_rows: int = SLICE) -> DataFrame:
    """query_id, rank, vec_id, score for each row of ``queries`` against all of ``vectors``; both written tables of quantized().

    Each vector travels once per block of queries, each query once per slice.
    """
    blocks, slices = (max(1, -(-df.count() // size)) for df, size in ((queries, block), (vectors, slice_rows)))
    own = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("long")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    cells = queries.select(own(blocks).alias("b"), each(slices).alias("s"), F.lit(0).alias("kind"), "row", "vec_id", "v").unionByName(
        vectors.select(each(blocks).alias("b"), own(slices).alias("s"), F.lit(1).alias("kind"), "row", "vec_id", "v")
    )

    def columns(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        ids = b.column(4)
        return b.column(3).to_numpy(), ids.fill_null(LONG.max).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), b.column(5)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        best, now = None, None

        def result() -> pa.RecordBatch:
            at = np.nonzero(best.full)
            cols = [pa.array(q_row[at[0]]), pa.array(q_id[at[0]]), pa.array(best.id[at], pa.int64(), mask=best.none[at]), pa.array(best.score[at])]
            return pa.record_batch(cols, ["query_row", "query_id", "vec_id", "score"])

        for batch in batches:
            code = batch.column(0).to_numpy() * slices + batch.column(1).to_numpy()
            kind = batch.column(2).to_numpy()
            cuts = np.nonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (kind[1:] != kind[:-1]))))[0].tolist()
            for a, z in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                part = batch.slice(a, z - a)
                if code[a] != now:
                    if best is not None:
                        yield result()
                    held, best, now = [], None, code[a]
                if kind[a] == 0:
                    held.append(columns(part))
                    continue
                if not held:
                    continue  # no query was dealt to this block
                if best is None:
                    width = max(int(np.diff(h[3].offsets.to_numpy()).max(initial=0)) for h in held)
                    q = np.concatenate([matrix(h[3], width) for h in held])
                    q_row, q_id = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                    best = Best(len(q), k)
                for at in range(0, part.num_rows, CHUNK):
                    row, id_, none, v = columns(part.slice(at, CHUNK))
                    r, col, s = _pairs(q, matrix(v), best.limit(), q_row[:, None] == row[None, :], k, None)
                    best.add(r, s, id_[col], none[col])
        if best is not None:
            yield result()

    found = cells.repartition("b", "s").sortWithinPartitions("b", "s", "kind").mapInArrow(score, FOUND)
    w = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
