"""Queries of the training-data operators, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from readlake.llm import chat_format, decontaminate, jaccard, katz, license_scan, line_dedup, mixing, quality_classifier, quality_rules, token_output


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.allot(_table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.materialise_order(_table(spark, sf_dir, "documents"))


def op4_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(_table(spark, sf_dir, "documents"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.cluster(_table(spark, sf_dir, "documents"), k=4, percent=85)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(_table(spark, sf_dir, "documents"), quality_classifier.labels_of(spark, sf_dir))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.digest(chat_format.format_conversations(chat_format.with_tricky(_table(spark, sf_dir, "conversations"))))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_source_mixing, op3_token_output, op4_katz_backoff, op5_ngram_jaccard, op6_quality_rules, op7_quality_classifier, op8_decontamination, op9_chat_format, op10_line_dedup)}
ORACLE = {"op2_source_mixing": mixing.ORACLE, "op5_ngram_jaccard": jaccard.ORACLE, "op6_quality_rules": quality_rules.ORACLE, "op8_decontamination": decontaminate.ORACLE, "op9_chat_format": chat_format.ORACLE, "op10_line_dedup": line_dedup.ORACLE}
