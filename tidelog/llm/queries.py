"""The queries of the training-data operators: operators with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, license_scan, mixing, near_dedup, packing, quality_rules, secret_scan, token_counts, topk_search, url_filter
from .common import stored, table


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, _ = stored(topk_search.quantized(table(spark, sf_dir, "embeddings")), "vectors")
    return topk_search.topk(v, v.where("vec_id % 50 = 0"), k=5)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist, _ = stored(token_counts.histogram(table(spark, sf_dir, "documents")), "lengths")  # read twice, counted once
    return token_counts.suffix_sums(hist)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan(docs, license_scan.index(docs, license_scan.default_templates(spark)))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secret_scan.train(secret_scan.default_samples(spark))
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), model))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    model = language_id.fit(docs.where(~out))
    return language_id.predict(docs.drop("lang"), model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality_rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return led.select(
        "doc_id", *[F.col(f"_q_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        (~quality_rules.passes("base")).alias("base_failed"), quality_rules.passes("v1").alias("kept"), F.col("_q_bits").alias("bits"),
    )


def op9_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole corpus mixed to the default targets; posteriors as one column per domain."""
    got, _ = mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return got.select("doc_id", "tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(mixing.DOMAINS)], "rate")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_url_filters, op2_topk_search, op3_token_counts, op4_best_fit_packing, op5_license_scans, op6_secret_scans, op7_language_id, op8_quality_rules, op9_mixing_sources, op10_minhash_near_dedup)
}
