"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A source's documents are repeated at a target mean rate = weight * epoch rows / rows of the source.
Each document's own count comes from inverting the Poisson distribution at a hash of the seed and its
id, so it needs no state and no second look at other documents; copies are exploded and dealt into
a global order by a hash of the seed, the id and the copy's number.

At most len(weights) + 1 counts reach the driver: sources without a weight are counted as one.
Their documents are repeated at `default_rate`. A rate beyond `PIECE` is a sum of Poisson pieces, each
with a hash of its own, so that the inversion stays exact for any rate.

Defined cases: a null source is a source without a weight; a source of the weights without rows takes
no part, the others keep their own targets; a weight of 0 drops the source; repeated ids, also null
ones, get equal counts and stay distinct rows; an empty table gives no rows; columns of the input stay
as they are, unless they have a name that is asked for the copy columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlace.llm.tables import table

#: Largest mean of one inversion.
PIECE = 8.0
#: Terms of a distribution function: beyond, a mean of PIECE has a tail below 1e-17.
TERMS = 48
#: Weights of the registered query and the pipeline: shares of the epoch's rows.
WEIGHTS: dict[str, float] = {"src0": 0.20, "src1": 0.08, "src2": 0.08, "src3": 0.06, "src4": 0.06, "src5": 0.02, "src6": 0.02}
SEED = 20
_BITS = 52


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the md5 of the parts' text."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << _BITS)


def poisson_cdf(mean: float) -> list[float]:
    """P(count <= k) for k = 0 ... TERMS - 1."""
    term, total, out = math.exp(-mean), 0.0, []
    for k in range(TERMS):
        total += term
        out.append(total)
        term *= mean / (k + 1)
    return out


def poisson_count(mean: float, *parts: Column) -> Column:
    """The count at which the distribution function passes the hash; parts: what the hash is of."""
    if mean <= 0:
        return F.lit(0)
    pieces = math.ceil(mean / PIECE)
    cdf = F.array(*[F.lit(x) for x in poisson_cdf(mean / pieces)])
    # a draw is bound to a variable, so its hash is taken once and not for each term
    draws = F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda i: uniform(*parts, i))
    return F.aggregate(draws, F.lit(0), lambda n, u: n + F.size(F.filter(cdf, lambda c: c < u)))


def source_rates(documents: DataFrame, weights: dict[str, float], epoch_rows: float | None = None, source_col: str = "source", default_rate: float = 1.0) -> dict[str | None, float]:
    """Mean repetitions by source; None holds that of all other sources."""
    named = F.col(source_col).isin(*weights) if weights else F.lit(False)
    counted = documents.groupBy(F.when(named, F.col(source_col)).alias("k")).count().collect()
    rows = {r["k"]: r["count"] for r in counted}
    epoch = sum(rows.values()) if epoch_rows is None else epoch_rows
    return {None: default_rate} | {k: w * epoch / rows[k] for k, w in weights.items() if rows.get(k)}


def mix_sources(
    documents: DataFrame,
    weights: dict[str, float],
    epoch_rows: float | None = None,
    seed: int = SEED,
    id_col: str = "doc_id",
    source_col: str = "source",
    default_rate: float = 1.0,
    copy_col: str | None = "copy",
    key_col: str | None = "shuffle_key",
    partitions: int | None = None,
) -> DataFrame:
    """All columns of documents, a row for each copy, in a global pseudo-random order: the rows of partition p
    stand before those of p + 1, and within a partition they ascend by shuffle_key, a long below 2**52.
    copy_col and key_col name the columns to add, or leave one out if None."""
    spark = documents.sparkSession
    rates = source_rates(documents, weights, epoch_rows, source_col, default_rate)
    count = F.lit(None).cast("int")
    for name, rate in rates.items():
        if name is not None:
            count = F.when(F.col(source_col) == name, poisson_count(rate, F.lit(seed), F.col(id_col))).otherwise(count)
    count = F.coalesce(count, poisson_count(rates[None], F.lit(seed), F.col(id_col)))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    copy, key, kept = "__copy", "__key", documents.columns
    copies = documents.select("*", F.explode(F.when(count > 0, F.sequence(F.lit(1), count))).alias(copy))
    keyed = copies.withColumn(key, F.floor(uniform(F.lit(f"{seed}-order"), F.col(id_col), F.col(copy)) * float(1 << _BITS)).cast("long"))
    # the key is uniform, so equal ranges of it are equal partitions: no sampling pass is needed
    dealt = keyed.repartitionById(n, F.floor(F.col(key) / (float(1 << _BITS) / n)).cast("int")).sortWithinPartitions(key, id_col, copy)
    out = [F.col(c) for c in kept if c not in (copy_col, key_col)]
    if copy_col:
        out.append(F.col(copy).cast("long").alias(copy_col))
    if key_col:
        out.append(F.col(key).alias(key_col))
    return dealt.select(*out)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), WEIGHTS)


def op5_sql() -> str:
    weights = ", ".join(f"('{k}', {w!r}::DOUBLE)" for k, w in WEIGHTS.items())
    u = lambda *x: "((('0x' || md5(" + " || ':' || ".join(x) + f")[1:13])::BIGINT)::DOUBLE + 0.5) / {1 << _BITS}.0"
    return f"""
WITH weights AS (SELECT * FROM (VALUES {weights}) AS v(source, weight)),
rates AS (
  SELECT d.source, CASE WHEN any_value(weight) IS NULL THEN 1.0::DOUBLE
    ELSE any_value(weight) * (SELECT count(*) FROM documents) / count(*) END AS rate
  FROM documents d LEFT JOIN weights w ON d.source = w.source GROUP BY d.source
), pieces AS (
  SELECT source, rate, ceil(rate / {PIECE}) AS n, rate / greatest(ceil(rate / {PIECE}), 1) AS mean FROM rates WHERE rate > 0
), cdf AS (
  SELECT source, k, sum(exp(k * ln(mean) - mean - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS p
  FROM pieces, range(0, {TERMS}) AS r(k)
), draws AS (
  SELECT d.doc_id, d.source, {u(f"'{SEED}'", "coalesce(d.doc_id::VARCHAR, '')", "i::VARCHAR")} AS u
  FROM (SELECT DISTINCT doc_id, source FROM documents) d JOIN pieces p ON d.source IS NOT DISTINCT FROM p.source, LATERAL (SELECT unnest(range(0, p.n::BIGINT)) AS i)
), counts AS (
  SELECT doc_id, d.source, sum((SELECT count(*) FROM cdf c WHERE c.source IS NOT DISTINCT FROM d.source AND c.p < d.u)) AS n
  FROM draws d GROUP BY doc_id, d.source
)
SELECT d.*, copy, floor({u(f"'{SEED}-order'", "coalesce(d.doc_id::VARCHAR, '')", "copy::VARCHAR")} * {1 << _BITS}.0)::BIGINT AS shuffle_key
FROM documents d JOIN counts c ON d.doc_id IS NOT DISTINCT FROM c.doc_id AND d.source IS NOT DISTINCT FROM c.source, LATERAL (SELECT unnest(range(1, c.n::BIGINT + 1)) AS copy)
"""
