"""A training-data pipeline over `documents`: each stage works on all that its predecessor kept.

Quality rules drop documents, the n-gram Jaccard join leaves one document of each group of
near-duplicates (five words, 0.8), suffix-array dedup cuts passages of over 50 words and, of what is
left, strings of 400 bytes that repeat, secret scans mask secrets, and best-fit packing deals the rest into sequences.

All stages take null in any column, empty and very long texts and empty tables; text that is null or
has under 50 words goes in the first stage, and rows with equal texts become one in the second, whatever their
other columns hold (of equal doc_ids, one of them).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from latticeforge.llm import _session, ngram_join, packing, quality, secret_scan, suffix_dedup

def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.train_quality_model(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one_each(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    passages = suffix_dedup.remove_repeats(docs, words=suffix_dedup.PASSAGE_WORDS)
    return suffix_dedup.remove_repeats(_session.stored(passages, "pipeline-passages"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact_secrets(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("mask_secrets", mask_secrets),
    ("pack_sequences", pack_sequences),
]

#: SQL cannot express the trained classifier; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what one keeps is written and read again as the next one's input."""
    docs = _session.documents(spark, sf_dir)
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = _session.stored(docs, f"pipeline-{name}")
    return docs
