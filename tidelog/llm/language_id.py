"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams (1 to 3 characters, lower-cased letters, other characters folded to one
space); term frequency is relative to the text's n-grams. Document frequencies are counted over all
training rows. Weights are trained by follow-the-regularised-leader (FTRL-proximal) with elastic-net
penalties on a bounded sample of training rows (``SAMPLE``, the documented bound), then a temperature
is fitted on a part of the sample kept aside. Prediction reads whole texts.

Defined results: a null text, or one without a letter, gives ``und`` with score 0; no training rows
give ``und`` for every row; repeated rows are predicted alike; extra columns are never read. Only the
training text and its language are learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import thinned

BUCKETS = 1 << 16
SAMPLE, EPOCHS = 3000, 6
ALPHA, BETA, L1, L2 = 0.5, 1.0, 2e-4, 1e-4
SPACE = 32


def codes(text: str) -> np.ndarray:
    """Lower-cased code points with each run of other characters folded to one space, a space at each end."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(_letters()[c], c, SPACE)
    c = np.concatenate(([SPACE], c, [SPACE])).astype(np.uint32)
    return c[np.concatenate(([True], (c[1:] != SPACE) | (c[:-1] != SPACE)))]


_table: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _table
    if _table is None:
        _table = np.array([chr(i).isalpha() for i in range(0x110000)], bool)
    return _table


def grams(text: str) -> np.ndarray:
    """Bucket of every n-gram of the whole text; empty if it has no letter."""
    c = codes(text)
    if len(c) < 2:
        return np.empty(0, np.uint32)
    one = c * np.uint32(2654435761)
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(2246822519) + one[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(3266489917) + one[2:]
    h = np.concatenate((one, two + np.uint32(1), three + np.uint32(2)))
    h ^= h >> np.uint32(16)
    return (h * np.uint32(2246822519)) >> np.uint32(16)


@dataclass
class Model:
    classes: list[str]
    weights: np.ndarray  # BUCKETS x classes, IDF folded in
    bias: np.ndarray
    temperature: float

    def logits(self, g: np.ndarray) -> np.ndarray:
        return (self.weights[g].sum(axis=0) / len(g) + self.bias) / self.temperature


def document_frequency(rows: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """Documents per bucket over all rows, and their number; each task adds up its own first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS, np.int64), 0
        seen = np.zeros(BUCKETS, bool)
        for b in batches:
            for t in b.column(0):
                g = grams(t.as_py() or "")
                seen[:] = False
                seen[g] = True
                df += seen
                n += 1
        at = np.nonzero(df)[0]
        yield pa.record_batch([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["b", "n"])

    got = rows.select(F.col(text).cast("string").alias("t")).mapInArrow(count, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(BUCKETS)
    known = got[got.b >= 0]
    df[known.b.to_numpy(np.int64)] = known.n.to_numpy()
    return df, int(got[got.b < 0].n.sum())


def features(rows: DataFrame, text: str = "text", label: str = "lang") -> pd.DataFrame:
    """(lang, buckets, counts) of every row: what the driver gets of the bounded sample."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            us, cs = [], []
            for t in b.column(0):
                u, c = np.unique(grams(t.as_py() or ""), return_counts=True)
                us.append(u.astype(np.int32))
                cs.append(c.astype(np.int32))
            yield pa.record_batch([b.column(1), pa.array(us, pa.list_(pa.int32())), pa.array(cs, pa.list_(pa.int32()))], ["lang", "u", "c"])

    return rows.select(F.col(text).cast("string"), F.col(label).cast("string")).mapInArrow(make, "lang string, u array<int>, c array<int>").toPandas()


def ftrl(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, k: int, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal per coordinate and class; returns weights and bias."""
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))

    def weights(i):
        zi, ni = z[i], n[i]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for j in rng.permutation(len(x)):
            i, v = x[j]
            w = weights(i)
            s = v @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[j]] -= 1.0
            g = v[:, None] * p[None, :]
            g2 = g * g
            z[i] += g - (np.sqrt(n[i] + g2) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g2
    w = weights(slice(None))
    return w[:-1], w[-1]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The scale that minimises log loss, by golden-section search over log t."""
    if not len(y):
        return 1.0

    def loss(t):
        s = logits / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float(-(s[np.arange(len(y)), y] - np.log(np.exp(s).sum(axis=1))).mean())

    a, b, r = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(50):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(train: DataFrame, text: str = "text", label: str = "lang", sample: int = SAMPLE, id_col: str = "doc_id") -> Model | None:
    """Train on rows with a non-null text and language; None if there are none."""
    rows = train.where(F.col(text).isNotNull() & F.col(label).isNotNull())
    df, n = document_frequency(rows, text)
    if not n:
        return None
    hashed = rows.select(text, label, F.xxhash64(id_col, text).alias("_h")).where(thinned(F.col("_h"), 2 * sample, n))
    got = features(hashed.orderBy("_h").limit(sample), text, label)
    got = got[got.u.map(len) > 0]
    if not len(got):
        return None
    classes = sorted(got.lang.unique())
    idf = np.log((1 + n) / (1 + df)) + 1
    x, y = [], got.lang.map({c: i for i, c in enumerate(classes)}).to_numpy()
    for u, c in zip(got.u, got.c, strict=True):
        u, c = np.asarray(u, np.int64), np.asarray(c, float)
        x.append((np.append(u, BUCKETS), np.append(c / c.sum() * idf[u], 1.0) * np.append(np.full(len(u), 10.0), 1.0)))
    aside = np.arange(len(x)) % 5 == 0 if len(x) >= 50 else np.zeros(len(x), bool)
    w, b = ftrl([x[i] for i in np.nonzero(~aside)[0]], y[~aside], len(classes))
    full = np.vstack([w, b])
    held = np.array([v @ full[i] for (i, v), a in zip(x, aside, strict=True) if a]).reshape(-1, len(classes))
    return Model(classes, (w * idf[:, None] * 10.0).astype(np.float32), b, temperature(held, y[aside]))


def predict(docs: DataFrame, model: Model | None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, lang_pred, score) for every row; the model is of fixed size and broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            lang, score = [], []
            for t in b.column(1):
                g = grams(t.as_py() or "") if m else ()
                if not len(g):
                    lang.append("und")
                    score.append(0.0)
                    continue
                s = m.logits(g)
                p = np.exp(s - s.max())
                k = int(p.argmax())
                lang.append(m.classes[k])
                score.append(float(p[k] / p.sum()))
            yield pa.record_batch([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text).cast("string").alias("t")).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")
