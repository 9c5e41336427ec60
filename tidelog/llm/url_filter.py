"""URL filters: allow/block rules first, then empirical-Bayes host reputation.

Labelled page outcomes are counted per host, registered domain and suffix. Each level is a
beta-binomial whose prior mean is the level above; prior strengths come from the between-group
variance (method of moments). A page whose url fits no rule is blocked where the host's posterior
upper bound is well below the mean over all hosts. Where hosts differ no more than by chance, all have
that mean and none is blocked.

Defined results: a null url, or one without ``://``, has an empty host and path and is judged by the
reputation of the empty host; null outcomes and null ids carry no label; repeated outcomes of an id
count once (any bad one wins); repeated pages are judged each; no outcomes leave the global prior,
which allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: A host is blocked where its upper bound is below this part of the mean over all hosts.
RATIO, Z = 0.8, 1.645
#: Groups that vary no more than chance would have it are as one: the strength is this.
ALIKE = 1e9


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def registered_domain(host: Column) -> Column:
    """The last two labels (the last label where there is one only)."""
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def rule_columns(rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits columns ``host`` and ``path``; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: len(r[0])):
        h, _, p = text.partition("/")
        fits = ((F.col("host") == h) | F.endswith("host", F.lit(f".{h}"))) & F.startswith("path", F.lit(f"/{p}"))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def outcomes(labels: DataFrame) -> DataFrame:
    """(id, good) from a labelled table: good where quality is 1 and the page isn't toxic."""
    return (
        labels.where("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").alias("id"))
        .agg(F.min(F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0)).alias("good"))
    )


def strength() -> Column:
    """Aggregate: prior strength from groups (n, k, prior mean m) by the method of moments, at least 1."""
    n, k, m = F.col("n"), F.col("k"), F.col("m")
    v = F.sum(n * m * (1 - m))
    s = F.sum((k - n * m) * (k - n * m))
    extra = F.sum(n * (n - 1) * m * (1 - m))
    rho = (s - v) / F.nullif(extra, F.lit(0.0))
    return F.greatest(F.lit(1.0), F.least(F.lit(ALIKE), F.coalesce(F.when(rho > 0, 1 / rho - 1), F.lit(ALIKE))))


def reputation(labelled: DataFrame) -> DataFrame:
    """(host, n, k, mean, upper, overall) from rows (host, good); counts are combined before any shuffle.

    The host table is the only one that grows; it is written once and the levels above are aggregates
    of it. Only single numbers reach the driver.
    """
    host, _ = stored(labelled.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("k")), "hosts")
    host = host.withColumns({"domain": registered_domain(F.col("host")), "suffix": suffix_of(F.col("host"))})
    domain = host.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffix = domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    mean = lambda a: (F.col("k") + F.lit(a) * F.col("m")) / (F.col("n") + F.lit(a))
    total = host.agg(((F.coalesce(F.sum("k"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("m")).first().m
    suffix = suffix.withColumn("m", F.lit(total))
    suffix = suffix.select("suffix", mean(suffix.agg(strength().alias("a")).first().a).alias("m"))
    domain = domain.join(suffix, "suffix")
    domain = domain.select("domain", mean(domain.agg(strength().alias("a")).first().a).alias("m"))
    host = host.join(domain, "domain")
    a = host.agg(strength().alias("a")).first().a
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.lit(a) + 1))
    return host.select("host", "n", "k", mean(a).alias("mean")).withColumns({"upper": F.least(F.lit(1.0), F.col("mean") + Z * sd), "overall": F.lit(total)})


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, ratio: float = RATIO, id_col: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule, verdict, and the host's labelled count."""
    p = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    marked = p.select("page_id", "host").join(outcomes(labels).withColumnRenamed("id", "page_id"), "page_id", "left")
    rep = reputation(marked).select("host", F.col("n").alias("n_labelled"), (F.col("upper") < ratio * F.col("overall")).alias("bad"))
    rule, verdict = rule_columns(rules)
    return p.join(rep, "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("bad"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.coalesce("n_labelled", F.lit(0)).cast("long").alias("n_labelled"),
    )
