"""A training corpus from ``documents``: five stages, each written as Parquet and read by the next.

Quality rules drop rejected documents; near-duplicate classes keep one document each; secrets are
blanked out inside the text; mixing weighs domains to target shares by repeating documents (clean ones
are never dropped); what is left is packed into sequences.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import mixing, near_dedup, packing, quality_rules, secret_scan
from tidelog.llm.common import stored, table

log = logging.getLogger("corpus_pipeline")
#: Shares of tokens after mixing, as far as they can be had without thinning clean documents.
TARGETS = {"clean": 0.97, "low": 0.01, "toxic": 0.02}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.apply_policy(docs, "v1")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text become a mark and ``n_chars`` follows."""
    out = secret_scan.redact(docs, secret_scan.train(secret_scan.default_samples(spark)))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in whole copies whose expectation is their rate; the fit keeps rates of likely clean ones at 1 or more."""
    got, error = mixing.mix(docs, table(spark, sf_dir, "labels"), TARGETS, carry=tuple(docs.columns), prefix="_m_", whole="clean")
    log.info("mixing: errors in parts of the targets %s", dict(zip(TARGETS, error, strict=True)))
    n = mixing.copies(F.col("_m_rate"), F.col("doc_id"), F.col("text"))
    return got.withColumn("_m_copy", F.explode(F.array_repeat(F.lit(1), n))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("secret scans", secrets),
    ("mixing to targets", mix),
    ("best-fit packing", pack),
]
#: No SQL can express near-duplicate signatures, a trained classifier or tokenization.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents`` of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, _ = stored(docs, f"stage{k}")
    return docs
