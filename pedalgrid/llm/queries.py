"""The operators as named queries over one input folder, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pedalgrid.llm import (
    bpe_codec,
    count_min_dedup,
    decontaminate,
    jaccard_join,
    language_id,
    license_scan,
    line_dedup,
    merkle_manifest,
    quality_rules,
    repeat_spans,
    secret_scan,
    spelling_variants,
    warc_captures,
)
from pedalgrid.llm.common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_digests(table(spark, sf_dir, "documents"))


def op2_repeat_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_spans.repeat_digests(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digests(table(spark, sf_dir, "documents"))


def op5_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_captures.capture_digests(table(spark, sf_dir, "pages"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents")).drop("k1", "k2")


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode(table(spark, sf_dir, "documents"), output="digests")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("k1", "k2", "by_minhash")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.manifest_digests(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_digests(table(spark, sf_dir, "documents"))


def op13_count_min_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_min_dedup.window_digests(table(spark, sf_dir, "documents"))


QUERIES = [
    op1_line_dedup,
    op2_repeat_spans,
    op3_language_id,
    op4_secret_scan,
    op5_warc_captures,
    op6_jaccard_join,
    op7_quality_rules,
    op8_bpe_codec,
    op9_license_scan,
    op10_decontaminate,
    op11_merkle_manifest,
    op12_spelling_variants,
    op13_count_min_dedup,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    """Language models, automata and token ids are beyond SQL."""
    return {
        "op1_line_dedup": line_dedup.SQL,
        "op2_repeat_spans": repeat_spans.SQL,
        "op5_warc_captures": warc_captures.SQL,
        "op6_jaccard_join": jaccard_join.SQL,
        "op7_quality_rules": quality_rules.SQL,
        "op9_license_scan": license_scan.SQL,
        "op10_decontaminate": decontaminate.SQL,
        "op11_merkle_manifest": merkle_manifest.SQL,
        "op12_spelling_variants": spelling_variants.SQL,
        "op13_count_min_dedup": count_min_dedup.SQL,
    }
