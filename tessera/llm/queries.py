"""Registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import leaks, licenses, lines, mixing, near, passages, private, quality, tokens, words
from tessera.llm.common import documents

VOCABULARY = "byte_bpe_50k.json"


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(documents(spark, sf_dir))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.personal_data(documents(spark, sf_dir), private.Disclosure(everywhere=True))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(documents(spark, sf_dir)).withColumn("removed", F.array_join("removed", ","))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(documents(spark, sf_dir))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.score(documents(spark, sf_dir))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(documents(spark, sf_dir).select("doc_id", "text"), VOCABULARY, keep=["doc_id"])


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(documents(spark, sf_dir))


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.assess(documents(spark, sf_dir).select("doc_id", "text"), keep=["doc_id"])
    return out.select("doc_id", "quality.*")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_source_mixing, op2_pii, op3_decontamination, op4_line_dedup, op5_minhash_near_dedup, op6_lm_scoring, op7_token_counts, op8_substring_dedup, op9_license_scans, op10_quality_rules)}
