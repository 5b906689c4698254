"""Registered queries of the operators; each reads its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hourmart.llm import (
    context_mixing, decontaminate, edit_counts, filter_audit, importance_rules, language_id, near_dedup, quality_mil, records, spelling,
    suffix_dedup, toxicity, word_bpe,
)
from hourmart.llm.oracles import DECONTAMINATE, FILTER_AUDIT, NEAR_DEDUP, QUALITY_RULES, SPELLING


BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("longest_match")


def op3_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.language_scores(table(spark, sf_dir, "documents"))


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.token_records(table(spark, sf_dir, "documents"), BYTE_BPE)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_bytes(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(table(spark, sf_dir, "documents"))


def op7_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mil.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_counts.edited_counts(table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.bpe_round_trip(table(spark, sf_dir, "documents"), WORD_BPE)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_context_mixing": op3_context_mixing,
    "op4_token_records": op4_token_records,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_language_id": op6_language_id,
    "op7_quality_mil": op7_quality_mil,
    "op8_edit_counts": op8_edit_counts,
    "op9_bpe_round_trip": op9_bpe_round_trip,
    "op10_quality_rules": op10_quality_rules,
    "op11_toxicity": op11_toxicity,
    "op12_filter_audit": op12_filter_audit,
    "op13_spelling": op13_spelling,
}

ORACLES = {
    "op1_near_dedup": NEAR_DEDUP,
    "op2_decontaminate": DECONTAMINATE,
    "op10_quality_rules": QUALITY_RULES,
    "op12_filter_audit": FILTER_AUDIT,
    "op13_spelling": SPELLING,
}
