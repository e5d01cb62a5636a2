"""A corpus pipeline of five stages over the documents table: each works on all that the one before kept.

run() writes each stage's rows as Parquet and reads them again for the next, so a lost executor costs one stage's tasks.
Null texts count as empty in every stage; empty tables give empty results; without ratings, or without test items, the
stage that needs them keeps all. Other columns of documents go along unread, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontamination, exact_dedup, near_dedup, quality
from lodestone.llm.common import materialize, table
from lodestone.llm.queries import bpe_digests


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier accepts; it learns from the ratings of those that it is given."""
    return quality.accept_rows(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of those whose texts are equal without white space: the longest, then the one with the smallest id."""
    return exact_dedup.drop_exact(docs)


def keep_representatives(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words a shingle, similarity of 0.8 or more."""
    return near_dedup.drop_near(docs, words=5, threshold=0.8)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item to 0.6 or more with tiles of five words and more."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens, and digests of the ids and of the decoded bytes, a row for each document."""
    return bpe_digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("exact_dedup", keep_distinct),
    ("near_dedup", keep_representatives),
    ("decontamination", keep_uncontaminated),
    ("byte_bpe", encode),
]

#: Quality, tiling and BPE have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        rows = materialize(stage(spark, rows, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, rows, sf_dir)
