"""Corpus pipeline: language ID, near-dedup, suffix dedup, decontamination, BPE round trip.

Each stage reads all that the one before it kept, as written; all but the last return documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hourmart.llm import decontaminate, language_id, near_dedup, suffix_dedup, word_bpe
from hourmart.llm.queries import WORD_BPE, table
from hourmart.llm.staging import Steps, give_back

#: Bytes of the shortest passage that is cut. Passages of over 50 words are to be caught: those of 51 words that
#: occur in several documents of sf0.01 have 245 bytes or more.
PASSAGE = 240


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those for which the learned network is hardly better than chance."""
    give_back(spark)
    return language_id.identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    give_back(spark)
    return near_dedup.deduplicated(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of PASSAGE bytes that start elsewhere too are cut out of the texts."""
    give_back(spark)
    return suffix_dedup.without_repeats(docs, length=PASSAGE)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window with the benchmark go."""
    give_back(spark)
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per remaining document: its number of tokens and the hashes of its ids and decoded text."""
    give_back(spark)
    return word_bpe.bpe_round_trip(docs, WORD_BPE)


STAGES = [
    ("language_id", language),
    ("near_dedup", near_duplicates),
    ("suffix_dedup", repeated_strings),
    ("decontamination", benchmark_passages),
    ("bpe", tokens),
]

ORACLE_SQL = None      # SQL can't express learned languages and merges; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`; each result is written and read again as the next one's input."""
    steps, docs, before = Steps(spark), table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, last = steps.keep(stage(spark, docs, sf_dir), name), docs
        if before is not None:
            steps.drop(last)
        before = last
    return docs
