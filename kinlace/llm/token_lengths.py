"""Exact histogram of encoded lengths, and what it answers for every context limit.

Documents are encoded once, where they lie, and only their lengths go on: a length's documents are
counted before the shuffle, so the histogram has one row per distinct length. Sums over longer lengths
are taken in two levels (bands of `BAND` lengths, then within a band), so no task sees the whole
histogram, only the bands' totals.

Defined cases: a null text is an empty text of length 0; repeated rows count each; an empty table gives
no rows; other columns are ignored. A token string of the vocabulary's file inside a text is text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinlace.llm.tables import saved, scratch, table

BAND = 128
VOCABULARY = "byte_bpe_50k.tiktoken"


@cache
def _encoder(path: str | None):
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded_lengths(documents: DataFrame, text_col: str = "text", vocabulary_path: str | None = None) -> DataFrame:
    """length long: the encoded length of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary_path).encode_ordinary
        for batch in batches:
            lengths = [len(encode(t)) if t else 0 for t in (x.as_py() for x in batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int64())], names=["length"])

    return documents.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "length long")


def length_histogram(documents: DataFrame, text_col: str = "text", vocabulary_path: str | None = None) -> DataFrame:
    """length, n_docs: one row for each encoded length that occurs."""
    counted = encoded_lengths(documents, text_col, vocabulary_path).groupBy("length").agg(F.count("*").alias("n_docs"))
    return saved(counted, scratch(documents.sparkSession, "lengths"))  # it is read twice, and texts are encoded once


def limit_answers(histogram: DataFrame) -> DataFrame:
    """For each length that occurs, taken as a context limit: n_docs of that length, docs_longer,
    docs_upto, tokens_upto (of documents within the limit), truncated_total (all documents cut at the
    limit), lost_tokens (what the cut drops), and quantile (share of documents within the limit)."""
    banded = histogram.withColumn("band", F.floor(F.col("length") / BAND)).withColumn("n_tokens", F.col("length") * F.col("n_docs"))
    bands = banded.groupBy("band").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    # as many rows as there are bands: the longest text's length / BAND
    after = Window.orderBy("band").rowsBetween(1, Window.unboundedFollowing)
    everything = Window.orderBy("band").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bands = bands.select(
        "band",
        F.coalesce(F.sum("d").over(after), F.lit(0)).alias("band_docs"),
        F.coalesce(F.sum("t").over(after), F.lit(0)).alias("band_tokens"),
        F.sum("d").over(everything).alias("all_docs"),
        F.sum("t").over(everything).alias("all_tokens"),
    )
    inside = Window.partitionBy("band").orderBy("length").rowsBetween(1, Window.unboundedFollowing)
    joined = banded.join(bands, "band").withColumn("docs_longer", F.col("band_docs") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0)))
    joined = joined.withColumn("tokens_longer", F.col("band_tokens") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    upto = F.col("all_tokens") - F.col("tokens_longer")
    cut = upto + F.col("docs_longer") * F.col("length")
    return joined.select(
        "length",
        "n_docs",
        "docs_longer",
        (F.col("all_docs") - F.col("docs_longer")).alias("docs_upto"),
        upto.alias("tokens_upto"),
        cut.alias("truncated_total"),
        (F.col("all_tokens") - cut).alias("lost_tokens"),
        ((F.col("all_docs") - F.col("docs_longer")) / F.col("all_docs")).alias("quantile"),
    )


def truncated_total(answers: DataFrame, limit: int) -> DataFrame:
    """One row: truncated_total for any limit, also one that is no document's length."""
    within = F.col("length") <= limit
    parts = F.when(within, F.col("length")).otherwise(limit) * F.col("n_docs")
    return answers.agg(F.coalesce(F.sum(parts), F.lit(0)).alias("truncated_total"))


def length_at_quantile(answers: DataFrame, q: float) -> DataFrame:
    """One row: the least length within which at least a share q of the documents lies."""
    return answers.filter(F.col("quantile") >= q).agg(F.min("length").alias("length"))


def op9_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limit_answers(length_histogram(table(spark, sf_dir, "documents")))
