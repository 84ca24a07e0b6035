"""From raw documents to token ids: quality rules, near-dedup, substring dedup, mixing, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from credit_engine.llm import mixing, near, pieces, quality, substrings
from credit_engine.llm.shared import documents, materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the label model and the base rules keep."""
    return quality.judge(docs).filter("kept").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents whose 5-word shingles are 0.8 similar or more, the one with the smallest id."""
    return near.keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated windows; n_chars follows the text, and those left without words go."""
    return substrings.remove_repeats(docs)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.repeat_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with ids, the text's tokens with begin and end ids."""
    return pieces.encode(docs, pieces.model_path())


#: Each stage's result is written as Parquet and read again as the next one's documents.
STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mixing_to_weights),
    ("sentencepiece", encoding),
]

#: None of the results can be had from SQL: label model, fingerprints, random rounding and tokens are not SQL's.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of documents with ids, for every document that the stages keep, as often as the mix takes it."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
