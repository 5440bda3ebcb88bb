"""One query for each corpus operator, over its whole table with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gateloom.llm import copair, images, katz, langid, mixing, packing, secrets, simhash, sketch, substring, tokencount, topk, whiten


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.without_repeats(documents(spark, sf_dir))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(documents(spark, sf_dir))


def op1_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The media column is made of the pages: no table holds images."""
    return images.image_copies(images.rasters(spark.read.parquet(f"{sf_dir}/pages.parquet"))).withColumnRenamed("id", "page_id")


def op2_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sources(documents(spark, sf_dir))


def op5_bottomk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.edited_fingerprints(documents(spark, sf_dir))


def op6_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(documents(spark, sf_dir))


def op7_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(documents(spark, sf_dir))


def op8_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(documents(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(documents(spark, sf_dir))


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_scores(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_cobucketed_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes files, so it has no SQL."""
    return copair.co_bucketed(spark.read.parquet(f"{sf_dir}/sales.parquet"), spark.read.parquet(f"{sf_dir}/sale_lines.parquet"))


def op13_exact_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_image_copies": op1_image_copies,
    "op2_poisson_mixing": op2_poisson_mixing,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_secret_scan": op4_secret_scan,
    "op5_bottomk_fingerprints": op5_bottomk_fingerprints,
    "op6_katz_scores": op6_katz_scores,
    "op7_simhash_components": op7_simhash_components,
    "op8_pattern_packing": op8_pattern_packing,
    "op9_token_counts": op9_token_counts,
    "op10_language_id": op10_language_id,
    "op11_exact_topk": op11_exact_topk,
    "op12_cobucketed_pair": op12_cobucketed_pair,
    "op13_exact_whitening": op13_exact_whitening,
}

ORACLE_SQL: dict[str, str] = {"op2_poisson_mixing": mixing.ORACLE, "op11_exact_topk": topk.ORACLE}
