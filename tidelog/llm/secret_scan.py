"""Secret scans: fixed patterns plus a character Markov log-likelihood ratio.

Two bigram models, one of random strings and one of ordinary identifiers, are trained from labelled
samples. A long token is a secret where the mean log-likelihood ratio per transition exceeds a
threshold. Everything runs as DataFrame expressions inside the document's own row.

Defined results: null text counts as empty; a text without matches gives zero counts and an empty
span string; rows are independent, so repeated rows, null ids and extra columns pass through.
"""

from __future__ import annotations

import hashlib
import math
from base64 import b64encode

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SPAN = "struct<s:int,k:int,e:int>"

_STEMS = (
    "get set make build parse read write open close user name file path index count value list map table row column key node "
    "edge graph token stream buffer cache lock thread queue task worker server client request response header body status error "
    "message event handler listener manager factory service config option setting default update insert delete select filter "
    "sort merge join group order limit offset start stop begin end first last next previous current total average maximum minimum "
    "length size width height color image text string number integer double float boolean array object class method function "
    "variable parameter argument return result output input source target origin destination the and tion ment ing ble over under "
    "inter national under standing responsibility environment development application information transaction isolation"
).split()


def default_samples(spark: SparkSession) -> DataFrame:
    """Labelled samples (text, random): digests in three encodings; composed identifiers and decimal numbers."""
    rows = []
    for i in range(400):
        d = hashlib.sha256(f"sample-{i}".encode()).digest()
        e = hashlib.sha512(f"sample-{i}".encode()).digest()
        rows += [(d.hex()[: 32 + i % 32], True), (b64encode(e).decode()[: 30 + i % 40], True)]
        rows.append(("".join(ALPHABET[b % 62] for b in e[: 24 + i % 30]), True))
        w = [_STEMS[(i * k + j) % len(_STEMS)] for j, k in enumerate((1, 7, 13, 29))]
        year = f"{2000 + i % 30}"
        rows += [("".join(str(b % 10) for b in e[: 12 + i % 20]), False), ("".join(w[:3]).upper(), False)]
        rows += [("_".join(w), False), ("".join(x.title() for x in w), False), ("-".join([*w[:3], year]), False), ("/".join(w), False), ("".join(w), False)]
    of = lambda kind: F.split(F.lit(" ".join(t for t, random in rows if random == kind)), " ")  # noqa: E731  samples hold no space
    one = lambda kind: spark.range(1).select(F.explode(of(kind)).alias("text"), F.lit(kind).alias("random"))
    return one(True).unionByName(one(False))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of every transition, row by row over ALPHABET plus one class for other characters.

    Add-one smoothing; no samples of a label leave its model uniform. What is collected is bounded by
    the number of transitions.
    """
    n = len(ALPHABET) + 1
    at = lambda c: F.when(F.instr(F.lit(ALPHABET), c) > 0, F.instr(F.lit(ALPHABET), c) - 1).otherwise(n - 1)
    pairs = (
        samples.where("text is not null and random is not null and length(text) > 1")
        .select("random", F.explode(F.sequence(F.lit(1), F.length("text") - 1)).alias("i"), "text")
        .select("random", F.substring("text", F.col("i"), F.lit(1)).alias("a"), F.substring("text", F.col("i") + 1, F.lit(1)).alias("b"))
        .groupBy("random", F.expr(f"case when instr('{ALPHABET}', a) > 0 then instr('{ALPHABET}', a) - 1 else {n - 1} end").alias("x"), F.expr(f"case when instr('{ALPHABET}', b) > 0 then instr('{ALPHABET}', b) - 1 else {n - 1} end").alias("y"))
        .count()
    )
    got = {(r.random, r.x, r.y): r["count"] for r in pairs.collect()}
    out = []
    for x in range(n):
        total = {k: sum(got.get((k, x, y), 0) for y in range(n)) + n for k in (True, False)}
        out += [math.log((got.get((True, x, y), 0) + 1) / total[True]) - math.log((got.get((False, x, y), 0) + 1) / total[False]) for y in range(n)]
    return out


def llr(text: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio per transition of ``text`` (0 for fewer than two characters)."""
    n = len(ALPHABET) + 1
    table = F.split(F.lit(",".join(f"{v:.6f}" for v in model)), ",").cast("array<double>")
    codes = lambda t: F.transform(F.split(t, ""), lambda c: F.coalesce(F.nullif(F.instr(F.lit(ALPHABET), c), F.lit(0)), F.lit(n)) - 1)
    total = F.aggregate(
        codes(text),
        F.struct(F.lit(-1).alias("p"), F.lit(0.0).alias("v")),
        lambda a, c: F.struct(c.cast("int").alias("p"), (a["v"] + F.when(a["p"] < 0, F.lit(0.0)).otherwise(F.coalesce(F.get(table, a["p"] * n + c), F.lit(0.0)))).alias("v")),
    )["v"]
    return F.when(F.length(text) > 1, total / (F.length(text) - 1)).otherwise(F.lit(0.0))


def _spans(text: Column, pattern: str, kind: int, keep=None, group: int = 0) -> Column:
    """Spans of all leftmost non-overlapping matches in code points: split gives what lies between."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("g"))
    none = F.array().cast(f"array<{SPAN}>")

    def step(a: Column, x: Column) -> Column:
        s = a["at"] + F.length(x["p"])
        e = s + F.coalesce(F.length(x["m"]), F.lit(0))
        good = x["m"].isNotNull() if keep is None else x["m"].isNotNull() & keep(x["g"])
        one = F.array(F.struct(s.alias("s"), F.lit(kind).alias("k"), e.alias("e")))
        return F.struct(e.alias("at"), F.when(good, F.concat(a["out"], one)).otherwise(a["out"]).alias("out"))

    found = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), step)["out"]
    return F.when(text.rlike(pattern), found).otherwise(none)


def scan(docs: DataFrame, model: list[float], text: str = "text", threshold: float = 0.4, prefix: str = "_s_") -> DataFrame:
    """``docs`` with ``<prefix>base`` and ``<prefix>all``: arrays of (start s, kind k, end e), sorted.

    Markov spans that overlap a base span are left out, so base spans always stay.
    """
    p, t = prefix, F.col(f"{prefix}t")
    out = docs.withColumn(f"{p}t", F.coalesce(F.col(text).cast("string"), F.lit("")))
    likely = lambda g: llr(g, model) > threshold
    out = out.select(
        "*",
        _spans(t, ASSIGN, 0, lambda g: F.length(g) >= 6, 1).alias(f"{p}x0"),
        _spans(t, ACCESS, 1, lambda g: F.length(g) >= 20).alias(f"{p}x1"),
        _spans(t, HEX, 2).alias(f"{p}x2"),
        _spans(t, TOKEN, 3, likely).alias(f"{p}x3"),
    )
    out = out.withColumn(f"{p}base", F.sort_array(F.concat(f"{p}x0", f"{p}x1", f"{p}x2")))
    base = F.col(f"{p}base")
    more = F.filter(f"{p}x3", lambda m: ~F.exists(base, lambda b: (b["s"] < m["e"]) & (m["s"] < b["e"])))
    return out.withColumn(f"{p}all", F.when(F.size(f"{p}x3") > 0, F.sort_array(F.concat(base, more))).otherwise(base)).drop(*[f"{p}x{k}" for k in range(4)], f"{p}t")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat(F.get(names, x["k"]), F.lit(":"), x["s"], F.lit(":"), x["e"])), ",")


def digest(scanned: DataFrame, id_col: str = "doc_id", prefix: str = "_s_") -> DataFrame:
    base, every = F.col(f"{prefix}base"), F.col(f"{prefix}all")
    n = lambda kind: F.size(F.filter(base, lambda x: x["k"] == kind)).cast("long")
    return scanned.select(
        id_col, n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(every).alias("spans"),
    )


def redact(docs: DataFrame, model: list[float], text: str = "text", mark: str = "<SECRET>", threshold: float = 0.4) -> DataFrame:
    """``docs`` with every secret span of ``text`` replaced by ``mark``; overlapping spans merge; null stays null."""
    out = scan(docs, model, text, threshold, "_r_")
    t = F.col(text)
    cut = F.aggregate(
        "_r_all",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, x: F.struct(
            F.greatest(a["at"], x["e"]).alias("at"),
            F.when(x["s"] >= a["at"], F.concat(a["out"], F.substring(t, a["at"] + 1, x["s"] - a["at"]), F.lit(mark))).otherwise(a["out"]).alias("out"),
        ),
        lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.length(t))),
    )
    return out.withColumn(text, F.when(F.size("_r_all") > 0, cut).otherwise(t)).select(*docs.columns)
