"""Corpus pipeline: from ``documents`` to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next
one's documents.  All but the last return the columns of documents.  A null text has no language and leaves in
the first stage; what the stages do with null ids, ties and repeated rows is stated in their operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logloom.llm import exact, langid, minhash, packing, suffix
from logloom.llm.common import cut, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found."""
    return langid.filter_known(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity 0.8."""
    return minhash.dedup(docs, width=5, percent=80)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 51 words, or of 400 bytes with fewer words, that start elsewhere as well."""
    return suffix.dedup_passages(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("packing", pack),
]

#: SQL can express neither the learned first stage nor the tokenizer of the last; tests/llm tests each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)
