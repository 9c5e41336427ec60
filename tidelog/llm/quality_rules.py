"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per failed
rule; policies are versioned masks over those bits, so changing a policy or asking what a rule costs
never reads the texts again.

Defined results: a null or empty text has no words and fails ``few_words``; rows are judged one by
one, so repeated rows, null ids and extra columns pass through; an empty table gives an empty ledger.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: name -> failure predicate in SQL over MEASURES; the position is the bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 30 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 50 * n_lines",
    "word_length": "word_chars > 15 * n_words or word_chars < 2 * n_words",
}
#: version -> rules in force
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": tuple(RULES),
}


def mask(policy: str | tuple[str, ...], rules: dict[str, str] = RULES) -> int:
    names = POLICIES[policy] if isinstance(policy, str) else policy
    return sum(1 << list(rules).index(n) for n in names)


def measures(docs: DataFrame, text: str = "text", prefix: str = "_q_") -> DataFrame:
    """``docs`` with the columns of MEASURES, named with ``prefix``.

    Three-word windows are compared as strings, so counts are exact. They are sorted within the
    document's own row; nothing is shuffled.
    """
    p = prefix
    out = docs.withColumn(f"{p}t", F.coalesce(F.col(text).cast("string"), F.lit("")))
    out = out.withColumn(f"{p}w", F.array_remove(F.split(f"{p}t", SPACE), ""))
    n = F.size(f"{p}w")
    m = F.greatest(n - 2, F.lit(0))
    lines = F.filter(F.split(f"{p}t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.select(
        *docs.columns,
        n.cast("long").alias(f"{p}n_words"),
        F.length(F.array_join(f"{p}w", "")).cast("long").alias(f"{p}word_chars"),
        (F.length(f"{p}t") - F.length(F.regexp_replace(f"{p}t", r"[#*$%&|<>]+", ""))).cast("long").alias(f"{p}n_symbols"),
        lines.alias(f"{p}l"),
        F.sort_array(
            F.arrays_zip(
                F.slice(f"{p}w", F.lit(1), m).alias("a"),
                F.slice(f"{p}w", F.lit(2), m).alias("b"),
                F.slice(f"{p}w", F.lit(3), m).alias("c"),
                F.when(m > 0, F.sequence(F.lit(1), m)).otherwise(F.array().cast("array<int>")).alias("i"),
            )
        ).alias(f"{p}z"),
    )
    z = F.col(f"{p}z")

    def same(x: Column, y: Column) -> Column:
        return (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

    twice = F.filter(z, lambda x, j: F.coalesce(same(x, F.get(z, j - 1)), F.lit(False)) | F.coalesce(same(x, F.get(z, j + 1)), F.lit(False)))
    out = out.withColumn(f"{p}at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    at = F.col(f"{p}at")
    covered = F.aggregate(
        F.transform(at, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x
    )
    return out.select(
        *docs.columns,
        *[f"{p}{c}" for c in ("n_words", "word_chars", "n_symbols")],
        F.size(f"{p}l").cast("long").alias(f"{p}n_lines"),
        (F.size(f"{p}l") - F.size(F.array_distinct(f"{p}l"))).cast("long").alias(f"{p}n_dup_lines"),
        covered.cast("long").alias(f"{p}n_repeat_words"),
    )


def failure_bits(rules: dict[str, str] = RULES, prefix: str = "_q_") -> Column:
    """One long with a bit per failed rule."""
    return reduce(
        lambda a, b: a.bitwiseOR(b),
        [F.when(F.expr(_prefixed(r, prefix)), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(rules.values())],
    )


def _prefixed(rule: str, prefix: str) -> str:
    return re.sub(rf"\b({'|'.join(MEASURES)})\b", rf"{prefix}\1", rule)


def ledger(docs: DataFrame, text: str = "text", rules: dict[str, str] = RULES, prefix: str = "_q_") -> DataFrame:
    """``docs`` with every measurement and ``<prefix>bits``."""
    return measures(docs, text, prefix).withColumn(f"{prefix}bits", failure_bits(rules, prefix))


def passes(policy: str | tuple[str, ...], bits: Column | str = "_q_bits") -> Column:
    """True where no rule of the policy failed."""
    c = F.col(bits) if isinstance(bits, str) else bits
    return c.bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def apply_policy(docs: DataFrame, policy: str = "v1", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns only.

    A plain filter would be pushed below the measuring projections, which copies their expressions
    into it many times over; a generator stays above them.
    """
    kept = F.explode(F.when(passes(policy), F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))).alias("_q_kept")
    return ledger(docs, text).select(*docs.columns, kept).select(*docs.columns)


def ablation(led: DataFrame, policy: str = "v1", bits: str = "_q_bits") -> DataFrame:
    """One row per rule of the policy: documents failing it, failing only it, kept with and without it.

    A single pass over the ledger; the bits of all documents are also folded with OR.
    """
    names, m, b = POLICIES[policy], mask(policy), F.col(bits)
    one = {n: 1 << list(RULES).index(n) for n in names}
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(b.bitwiseAND(F.lit(m).cast("long")) == 0).alias("kept"), F.bit_or(b).alias("seen")]
    for n in names:
        aggs += [
            F.count_if(b.bitwiseAND(F.lit(one[n]).cast("long")) != 0).alias(f"f_{n}"),
            F.count_if(b.bitwiseAND(F.lit(m).cast("long")) == one[n]).alias(f"o_{n}"),
        ]
    row = led.agg(*aggs)
    return row.select(
        F.inline(
            F.array(*[
                F.struct(
                    F.lit(policy).alias("policy"), F.lit(n).alias("rule"), F.col("n").alias("documents"), F.col(f"f_{n}").alias("failed"),
                    F.col(f"o_{n}").alias("failed_only_this"), F.col("kept"), (F.col("kept") + F.col(f"o_{n}")).alias("kept_without"),
                    (F.coalesce(F.col("seen"), F.lit(0)).bitwiseAND(F.lit(one[n]).cast("long")) != 0).alias("ever_failed"),
                )
                for n in names
            ])
        )
    )
