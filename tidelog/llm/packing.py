"""Best-fit packing with certified bounds.

Documents longer than a sequence are cut (the first piece takes the remainder); pieces are dealt to
groups of bounded size and packed by best-fit decreasing. Dual-feasible functions give each group a
lower bound on its sequences. Groups above their bound, and each group's emptiest sequence, hand the
pieces of unfilled sequences to an exchange, where they are dealt anew into larger mixes and packed
again; an exchange is kept only where it saves sequences.

Defined results: null text is empty and holds only the end id; repeated rows are packed each; an
empty table gives no rows; ids may be null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, stored
from .tokens import END, default_path, encoder

LIMIT, GROUP, ROUNDS = 1024, 16_384, 3
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, key long, grp long, bin long, offset long, fill long, bound long, bins long"


def pieces(docs: DataFrame, limit: int = LIMIT, text: str = "text", id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """One row per piece of PIECES; documents of at most ``limit`` ids stay whole."""
    path = path or default_path()
    end = np.uint32(END).tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = encoder(path).packed
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = packed(t.as_py() or "") + end
                n, at, k = len(raw) // 4, 0, 0
                size = n if n <= limit else n % limit or limit
                while at < n:
                    for c, v in zip(cols, (d, k, at, size, zlib.crc32(raw[4 * at : 4 * (at + size)])), strict=True):
                        c.append(v)
                    at, k, size = at + size, k + 1, limit
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("d"), F.col(text).cast("string").alias("t")).mapInArrow(cut, PIECES)


def lower_bound(sizes: np.ndarray, limit: int) -> int:
    """The largest of three families of dual-feasible functions, summed over all sizes, rounded up."""
    if not len(sizes):
        return 0
    h = np.bincount(sizes, minlength=limit + 1)[: limit + 1]
    x = np.arange(limit + 1, dtype=np.int64)
    best = -(-int((h * x).sum()) // limit)
    for e in range(1, limit // 2 + 1):  # sizes above limit - e count as full, those below e as nothing
        u = np.where(x > limit - e, limit, np.where(x >= e, x, 0))
        best = max(best, -(-int((h * u).sum()) // limit))
    for k in range(1, 21):  # rounding functions
        y = (k + 1) * x
        v = np.where(y % limit == 0, x * k, (y // limit) * limit)
        best = max(best, -(-int((h * v).sum()) // (limit * k)))
    return best


def best_fit(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(sequence, offset) of each size by best-fit decreasing, and the fill of each sequence.

    Open sequences lie in stacks by room; one integer's bits say which rooms exist.
    """
    order = np.argsort(-sizes, kind="stable")
    seq, off = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    rooms: list[list[int]] = [[] for _ in range(limit + 1)]
    bits, fill = 0, []
    for i, s in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = bits >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = rooms[r].pop()
            if not rooms[r]:
                bits &= ~(1 << r)
        else:
            b, r = len(fill), limit
            fill.append(0)
        seq[i], off[i] = b, fill[b]
        fill[b] += s
        r -= s
        if r:
            rooms[r].append(b)
            bits |= 1 << r
    return seq, off, fill


def _pack_group(limit: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "key"], ascending=[False, True], kind="stable").reset_index(drop=True)
        sizes = pdf["length"].to_numpy(np.int64)
        seq, off, fill = best_fit(sizes, limit)
        return pdf.assign(bin=seq, offset=off, fill=np.asarray(fill, np.int64)[seq], bound=lower_bound(sizes, limit), bins=len(fill))

    return pack


def _deal(rows: DataFrame, groups: int, salt: int, limit: int, shift: int) -> DataFrame:
    keyed = rows.withColumn("grp", F.pmod(F.xxhash64("key", F.lit(salt)), F.lit(groups)) + F.lit(shift))
    return keyed.groupBy("grp").applyInPandas(_pack_group(limit), PACKED)


def pack(docs: DataFrame, limit: int = LIMIT, text: str = "text", id_col: str = "doc_id", path: str | None = None, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """One row per piece: PIECES, sequence_id and offset."""
    spark = docs.sparkSession
    cut, cut_path = stored(pieces(docs, limit, text, id_col, path).withColumn("key", F.monotonically_increasing_id()), "pieces")
    n = cut.count()
    groups, shift = max(1, -(-n // group)), 0
    done, _ = stored(_deal(cut, groups, 0, limit, 0), "packed")
    drop(spark, cut_path)
    settled: list[DataFrame] = []
    for r in range(1, rounds + 1):
        # a group above its bound hands over every unfilled sequence, any other the clearly unfilled ones
        rows = done.withColumn("open", (F.col("fill") < limit) & ((F.col("bins") > F.col("bound")) | (F.col("fill") < limit - limit // 16)))
        state = rows.agg(F.count_if("open").alias("n"), F.sum(F.when(F.col("open"), F.col("length"))).alias("t"), F.count_distinct(F.when(F.col("open"), F.struct("grp", "bin"))).alias("b")).first()
        if not state.n or state.b <= -(-state.t // limit):
            break
        new_groups, base = max(1, -(-state.n // (group * 4))), shift + groups
        cols = [c.split()[0] for c in f"{PIECES}, key long".split(", ")]
        again, again_path = stored(_deal(rows.where("open").select(*cols), new_groups, r, limit, base), "exchange")
        after = again.agg(F.count_distinct(F.struct("grp", "bin")).alias("b")).first().b
        if after >= state.b:
            drop(spark, again_path)
            break
        settled.append(rows.where("not open").drop("open"))
        done, groups, shift = again, new_groups, base
    out = done
    for s in settled:
        out = out.unionByName(s)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("grp") * F.lit(1 << 32) + F.col("bin")).alias("sequence_id"), "offset")


def certificate(docs: DataFrame, limit: int = LIMIT, **kw) -> DataFrame:
    """(sequences, bound): what pack() used and the volume bound over all pieces."""
    return pack(docs, limit, **kw).agg(F.count_distinct("sequence_id").alias("sequences"), F.ceil(F.sum("length") / limit).alias("bound"))
