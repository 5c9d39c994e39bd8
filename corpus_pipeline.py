"""The corpus pipeline: language ID, near duplicates, repeated passages, benchmark leaks, then token ids.

Each stage takes all that the one before kept. All but the last return the columns of documents.

Defined results: texts that are null, empty or without letters go in the first stage; of documents that link, the one
with the smallest doc_id stays, and rows that repeat its doc_id; rows with a null doc_id are kept by the second and
fourth stages; repeated passages, which are strings of 400 bytes or of 51 words that also start elsewhere, go from all their copies
(op2's contract has the 400 bytes only), and a text of which no word is left goes too; a
document that holds a benchmark item goes. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, jaccard_join, language_id, suffix_dedup
from tidemark.llm._filter import without
from tidemark.llm._io import saved, table

LEAST_LANGUAGE_SCORE = 0.25


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accepted(docs, language_id.train(docs), LEAST_LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = saved(jaccard_join.join(docs).select("doc_id", "component_id"), "groups")
    lose = found.groupBy("doc_id").agg(F.bool_or(F.col("component_id") == F.col("doc_id")).alias("first")).where("not first").select("doc_id")
    return without(docs, lose, "doc_id")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    leaks = saved(decontaminate.matches(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "leaks")
    return without(docs, leaks, "doc_id")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", by_language),
    ("jaccard_join", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("decontaminate", benchmark_leaks),
    ("bpe", token_ids),
]
#: SQL can't express the first stage (fitted profiles) nor the fourth and fifth.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
