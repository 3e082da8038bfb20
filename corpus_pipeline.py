"""From raw documents to stored token ids, in stages that each write a table for the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinlace.llm import decontaminate, mixing, near_dup, quality_rules, token_store
from kinlace.llm.tables import saved, scratch, table, with_stored_order

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality_rules.quality_filter(docs, quality_rules.CLEAN_BANDS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, that with the least id."""
    return near_dup.drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated to their target weights, and rows dealt into a global order."""
    return mixing.mix_sources(docs, mixing.WEIGHTS, copy_col=None, key_col=None)


def store(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids go to a content-addressed store, in the order that mixing dealt; each document's recipe is read back and verified."""
    path = scratch(spark, "token-store")
    token_store.write_store(with_stored_order(docs, "place"), path, order_col="place")
    return token_store.document_summaries(spark, path)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", benchmark),
    ("mix_sources", mix),
    ("token_store", store),
]

#: SQL has neither zstandard, banded alignment nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), scratch(spark, name))
    return STAGES[-1][1](spark, docs, sf_dir)
