"""The text operators' queries over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logmill.llm import bpe, decontam, fingerprint, kdtree, licenses, quality, recompress, simhash, tokenids, urlfilter
from logmill.llm.base import table


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.duplicate_groups(table(spark, sf_dir, "documents"))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenids.token_table(table(spark, sf_dir, "documents"))


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.detections(table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.repeated_spans(table(spark, sf_dir, "documents")).drop("text_hash")


def op6_kd_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.shards(table(spark, sf_dir, "documents"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.apply_rules(table(spark, sf_dir, "pages"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_document_fingerprints,
    op2_token_output,
    op3_license_scans,
    op4_benchmark_decontamination,
    op5_substring_dedup,
    op6_kd_tree_sharding,
    op7_url_filters,
    op8_simhash_near_dedup,
    op9_quality_classifier,
    op10_byte_level_bpe,
)}
ORACLES: dict[str, str] = {"op1_document_fingerprints": fingerprint.ORACLE, "op4_benchmark_decontamination": decontam.oracle(), "op5_substring_dedup": recompress.oracle(), "op6_kd_tree_sharding": kdtree.oracle(), "op7_url_filters": urlfilter.oracle()}
