"""The corpus queries by name: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carepath.llm import digest_index, html_text, language, license_scan, line_dedup, manifest, mixing, near_dup, packing, preference, prefix_counts, quality, whitening
from carepath.llm.common import documents, prepare

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_id(documents(spark, sf_dir))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(documents(spark, sf_dir), width=3, percent=85)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(documents(spark, sf_dir))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_counts.token_counts(documents(spark, sf_dir))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hosts are the sources."""
    return line_dedup.line_dedup(documents(spark, sf_dir))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir)).drop("times")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(prepare(spark).read.parquet(f"{sf_dir}/pages.parquet"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history is one half of the table, by a hash of doc_id, and the other half arrives after it."""
    seen = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return digest_index.exact_dedup(documents(spark, sf_dir), seen)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(prepare(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.verified(documents(spark, sf_dir))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.quality_ranks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict[str, Query]:
    every = (
        op1_language_id,
        op2_near_duplicates,
        op3_license_scan,
        op4_token_counts,
        op5_quality_rules,
        op6_line_dedup,
        op7_source_mix,
        op8_html_text,
        op9_exact_dedup,
        op10_packing,
        op11_whitening,
        op12_manifest,
        op13_quality_classifier,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_near_duplicates": near_dup.sql(3, 85),
        "op3_license_scan": license_scan.SQL,
        "op6_line_dedup": line_dedup.SQL,
        "op7_source_mix": mixing.SQL,
        "op9_exact_dedup": digest_index.SQL,
        "op12_manifest": manifest.SQL,
    }
