"""Mixing sources to target weights by soft membership.

A classifier trained on a labelled table gives every document a posterior over domains. Nonnegative
document rates r are fitted so that the expected tokens per domain, sum(r * tokens * posterior), match
targets: least squares by projected gradient (with momentum) from r = 1, in the token-weighted metric, with a slight pull
towards r = 1: what a target cannot gain by moving rates, as that of a domain the corpus lacks, moves none. Documents are
counted by cells of a grid over posteriors: tokens and exact expected tokens per domain are summed per
cell across the cluster, the bounded table of cells is fitted, and every document takes its cell's rate,
so what the fit reports is true of the documents themselves. Tokens are ids of the public tokenizer.

Defined results: a null or empty text has no tokens and rate 1; no usable labels give every document
the same posterior over the given domains; targets are scaled to the corpus total; those beyond reach
are left as far off as the errors tell; an empty table
gives no rows; ids play no part in the fit, so null and repeated ones are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .common import stored, thinned
from .tokens import default_path, encoder

#: Bound of the labelled sample, of the vocabulary and of words taken per document for training.
SAMPLE, VOCAB = 3000, 50_000
#: The fit ends where the largest error is this part of the smallest target, or after so many steps.
STEPS, TOLERANCE = 20_000, 1e-3
#: Weight of the squared distance of rates from 1 beside the squared error of shares.
PULL = 1e-5
#: Cells are posteriors in whole multiples of 1 / GRID: at most (GRID + 1)(GRID + 2) / 2 for three domains.
GRID = 256
DOMAINS = ("clean", "low", "toxic")
TARGETS = {"clean": 0.90, "low": 0.04, "toxic": 0.06}


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, domain): toxic, else low quality, else clean; one label per id (any bad one wins)."""
    lab = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_q"), F.max("toxic").alias("_t"))
    domain = F.when(F.col("_t") == 1, "toxic").when(F.col("_q") == 0, "low").otherwise("clean")
    return docs.select("doc_id", "text").where("text is not null").join(lab, "doc_id").select("doc_id", "text", domain.alias("domain"))


class Classifier:
    """Logistic regression per domain (softmax) on which words occur, of fixed size."""

    def __init__(self, domains, vocab: dict[str, int], weights: np.ndarray, bias: np.ndarray):
        self.domains, self.vocab, self.weights, self.bias = list(domains), vocab, weights, bias

    def posterior(self, words) -> np.ndarray:
        at = [i for i in map(self.vocab.get, set(words)) if i is not None]
        s = self.bias + (self.weights[at].sum(axis=0) if at else 0.0)
        p = np.exp(s - s.max())
        return p / p.sum()

    def cell(self, p: np.ndarray) -> int:
        """The grid cell of a posterior as one number."""
        at = 0
        for x in np.floor(p[:-1] * GRID).astype(int).tolist():
            at = at * (GRID + 1) + x
        return at


def train(rows: list[tuple[str, str]], domains=DOMAINS, steps: int = 80) -> Classifier:
    """Fit on (text, domain) rows: words in two or more rows, most telling first, proximal gradient."""
    domains = list(domains)
    sets = [set((t or "").lower().split()) for t, _ in rows]
    y = np.array([domains.index(d) for _, d in rows], int)
    counts: dict[str, np.ndarray] = {}
    for s, k in zip(sets, y, strict=True):
        for w in s:
            counts.setdefault(w, np.zeros(len(domains)))[k] += 1
    if not rows:
        return Classifier(domains, {}, np.zeros((0, len(domains))), np.zeros(len(domains)))
    base = np.bincount(y, minlength=len(domains)) / len(rows)
    words = [w for w, c in counts.items() if c.sum() >= 2]
    c = np.array([counts[w] for w in words]).reshape(-1, len(domains))
    tell = np.abs(c - c.sum(axis=1, keepdims=True) * base).max(axis=1) / np.sqrt(c.sum(axis=1) + 1)
    best = sorted(range(len(words)), key=lambda i: (-tell[i], words[i]))[:VOCAB]
    vocab = {words[i]: j for j, i in enumerate(best)}
    # log-odds of presence under each domain, shrunk by a unit prior, then refined by gradient steps
    at = [np.array([vocab[w] for w in s if w in vocab], int) for s in sets]
    row = np.repeat(np.arange(len(at)), [len(a) for a in at])
    col = np.concatenate([*at, np.empty(0, int)]).astype(int)
    w, b = np.zeros((len(vocab), len(domains))), np.log(base + 1e-3)
    g2, gb2 = np.full_like(w, 1e-6), np.full_like(b, 1e-6)
    one = np.eye(len(domains))[y]
    for _ in range(steps):
        s = np.stack([np.bincount(row, w[col, k], len(at)) for k in range(len(domains))], axis=1) + b
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        r = (p - one) / len(at)
        g = np.stack([np.bincount(col, r[row, k], len(vocab)) for k in range(len(domains))], axis=1) + 1e-5 * w
        g2 += g * g
        w -= 0.1 * g / np.sqrt(g2)
        gb = r.sum(axis=0)
        gb2 += gb * gb
        b = b - 0.1 * gb / np.sqrt(gb2)
    return Classifier(domains, vocab, w, b)


def fit_classifier(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Train on at most ``sample`` labelled rows, chosen by hash."""
    known = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("_id")).distinct()
    h = F.xxhash64("_id")
    # ids first, by the same hash on either side: whole texts are read of the chosen ones only
    few = thinned(h, 4 * sample, known.count())
    there = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("_id")).where(few)
    picked = known.where(few).join(there, "_id", "left_semi").orderBy(h).limit(sample)
    chosen = docs.join(F.broadcast(picked), F.col("doc_id").cast("long") == F.col("_id"), "left_semi")
    got = labelled(chosen, labels).orderBy(F.xxhash64("doc_id", "text")).limit(sample).select("text", "domain").collect()
    return train([(r.text, r.domain) for r in got])


def memberships(docs: DataFrame, model: Classifier, text: str = "text", carry: tuple[str, ...] = ("doc_id",), prefix: str = "", path: str | None = None) -> DataFrame:
    """Columns ``carry`` with ``<prefix>tokens``, ``<prefix>p`` (array<double>) and ``<prefix>cell`` of every whole text."""
    sent, path = docs.sparkSession.sparkContext.broadcast(model), path or default_path()
    n = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, ids = sent.value, encoder(path).ids
        for b in batches:
            count, p, cell = [], [], []
            for t in b.column(n):
                t = t.as_py() or ""
                count.append(len(ids(t)))
                p.append(m.posterior(t.lower().split()))
                cell.append(m.cell(p[-1]))
            made = [pa.array(count, pa.int64()), pa.array(p, pa.list_(pa.float64())), pa.array(cell, pa.int64())]
            yield pa.record_batch([*b.columns[:n], *made], [*b.schema.names[:n], f"{prefix}tokens", f"{prefix}p", f"{prefix}cell"])

    kept = docs.select(*carry)
    schema = StructType([*kept.schema.fields, StructField(f"{prefix}tokens", LongType()), StructField(f"{prefix}p", ArrayType(DoubleType())), StructField(f"{prefix}cell", LongType())])
    return docs.select(*carry, F.col(text).cast("string").alias("_m_text")).mapInArrow(run, schema)


def projected_gradient(
    mass: np.ndarray, share: np.ndarray, steps: int = STEPS, tolerance: float = TOLERANCE, pull: float = 0.0, least: np.ndarray | float = 0.0
) -> tuple[np.ndarray, np.ndarray]:
    """Rates r >= ``least`` (cells) that bring sum(r * mass) (cells x domains) to ``share`` of its total, and what each domain is off, of the total.

    It ends where every domain is met, or where a step moves next to nothing.
    """
    total = mass.sum()
    tokens = mass.sum(axis=1)
    p = mass / tokens[:, None]
    step = 1.0 / (np.linalg.eigvalsh((p * tokens[:, None]).T @ p / total).max() + pull)
    r = np.maximum(least, np.ones(len(mass)))
    ahead, k = r, 1
    goal = tolerance * share[share > 0].min()
    for _ in range(steps):
        if np.abs(r @ mass / total - share).max() <= goal:
            break
        new = np.maximum(least, ahead - step * (p @ (ahead @ mass / total - share) + pull * (ahead - 1)))
        still = tokens @ np.abs(new - ahead) <= 1e-4 * step * pull * total
        if tokens @ ((ahead - new) * (new - r)) > 0:  # the momentum points uphill: it starts anew
            k = 1
        ahead, k = new + (k - 1) / (k + 2) * (new - r), k + 1
        r = new
        if still:
            break
    return r, r @ mass / total - share


def fit_rates(members: DataFrame, targets: dict[str, float] = TARGETS, domains=DOMAINS, prefix: str = "", steps: int = STEPS, tolerance: float = TOLERANCE, whole: str | None = None) -> tuple[DataFrame, list[float]]:
    """(<prefix>cell, <prefix>rate) per cell, and the error of each domain in parts of its target. One aggregation; its result is bounded by the grid.

    Documents whose posterior of the first domain is 0.5 or more get a rate of 1 at least if ``whole`` names it. Where they
    alone exceed that domain's target, all targets grow in proportion until they do not, so shares can still be met.
    """
    k, spark = len(domains), members.sparkSession
    share = np.array([max(0.0, targets.get(d, 0.0)) for d in domains])
    share = share / share.sum()
    n, p = F.col(f"{prefix}tokens"), F.col(f"{prefix}p")
    cells = members.where(n > 0).groupBy(f"{prefix}cell").agg(*[F.sum(n * p[i]).alias(f"m{i}") for i in range(k)]).orderBy(f"{prefix}cell").collect()
    schema = f"`{prefix}cell` long, `{prefix}rate` double"
    if not cells:
        return spark.createDataFrame([], schema), [0.0] * k
    least = np.array([float(whole == domains[0] and 2 * (c[0] // (GRID + 1) ** (k - 2)) >= GRID) for c in cells])
    mass = np.array([row[1:] for row in cells], float)
    if least.any() and share[0] > 0:
        share = share * max(1.0, least @ mass[:, 0] / (share[0] * mass.sum()))
    r, error = projected_gradient(mass, share, steps, tolerance, PULL, least)
    return spark.createDataFrame([(c[0], float(x)) for c, x in zip(cells, r, strict=True)], schema), (error / np.maximum(share, 1e-12)).tolist()


def mix(
    docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, model: Classifier | None = None, carry: tuple[str, ...] = ("doc_id",), prefix: str = "",
    whole: str | None = None,
) -> tuple[DataFrame, list[float]]:
    """For every row of ``docs`` its columns ``carry``, and tokens, p and rate named with ``prefix``; and the relative errors per domain.

    No document likely of the domain ``whole``, the first one, is thinned.

    What goes with a row is carried through the scoring, not joined back, so null and repeated ids keep
    their own rows. The rates that are broadcast are bounded by the grid.
    """
    model = model or fit_classifier(docs, labels)
    members, _ = stored(memberships(docs, model, carry=carry, prefix=prefix), "members")
    rates, error = fit_rates(members, targets, model.domains, prefix, whole=whole)
    tokens, rate = F.col(f"{prefix}tokens"), F.col(f"{prefix}rate")
    got = members.join(F.broadcast(rates), f"{prefix}cell", "left").withColumn(f"{prefix}rate", F.when(tokens > 0, rate).otherwise(F.lit(1.0)))
    return got.drop(f"{prefix}cell"), error


def copies(rate: Column, *key: Column) -> Column:
    """Whole copies whose expectation is the rate: the fraction is settled by a hash of ``key``."""
    whole = F.floor(rate)
    return (whole + F.when(F.pmod(F.xxhash64(*key), F.lit(1 << 30)) / float(1 << 30) < rate - whole, 1).otherwise(0)).cast("int")
