"""Exact nearest neighbours among vectors of one type, by blocked matrix products.

Vectors of a type are dealt into blocks of bounded size, and some blocks are a tile; each pair of tiles is a
group of its own, which gives the k nearest in one tile for each vector of the other, and these are ranked over tiles.
Memory of a task is bounded by two tiles, a block is sent once to each tile, and no key holds a whole type.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinlace.operators.staging import staged

BLOCK = 4_096
TILE = 4


def blocks(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """entry_type, block, ids, flat, dim: vectors packed `block` at a time. vectors: entry_id, entry_type, vector."""
    sized = vectors.filter(F.col("vector").isNotNull()).withColumn("dim", F.size("vector"))
    counts = sized.groupBy("entry_type", "dim").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    dealt = sized.join(counts, ["entry_type", "dim"]).withColumn("block", F.pmod(F.xxhash64("entry_id"), F.col("n")).cast("int"))
    packed = dealt.groupBy("entry_type", "dim", "block").agg(F.array_sort(F.collect_list(F.struct("entry_id", "vector"))).alias("rows"))
    return packed.select("entry_type", "dim", "block", F.transform("rows", lambda r: r["entry_id"]).alias("ids"), F.flatten(F.transform("rows", lambda r: r["vector"])).cast("array<float>").alias("flat"))


def knn(vectors: DataFrame, k: int, block: int = BLOCK, queries: DataFrame | None = None) -> DataFrame:
    """entry_id, neighbour_id, distance (L2), rank: the k nearest others of the same type, ties by id.
    queries: the rows whose neighbours are asked for, all of them unless given."""
    packed = staged(blocks(vectors, block), "knn-blocks")
    asked = packed if queries is None else staged(blocks(queries, block), "knn-queries")
    tile = F.floor(F.col("block") / TILE).cast("int")
    tiles = lambda df: df.groupBy("entry_type", "dim").agg(F.max(tile).alias("last"))
    other = lambda n: F.explode(F.sequence(F.lit(0), "last")).alias(n)
    key, q_key = ["entry_type", "dim", "i", "j"], ["q_type", "q_dim", "q_i", "q_j"]
    left = asked.join(tiles(packed), ["entry_type", "dim"]).select(F.col("entry_type").alias("q_type"), F.col("dim").alias("q_dim"), tile.alias("q_i"), other("q_j"), F.col("ids").alias("q_ids"), F.col("flat").alias("q_flat"))
    right = packed.join(tiles(asked), ["entry_type", "dim"]).select("entry_type", "dim", other("i"), tile.alias("j"), "ids", "flat")

    def nearest(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        if not len(asked) or not len(held):
            return pd.DataFrame(dict(zip(("entry_id", "neighbour_id", "distance"), out, strict=True)))
        dim = int(held["dim"].iloc[0])
        ids, v = (np.concatenate(list(held[c])) for c in ("ids", "flat"))
        v = v.astype(np.float64).reshape(-1, dim)
        lengths, found = (v * v).sum(1), []
        for q_ids, q in zip(asked["q_ids"], asked["q_flat"], strict=True):
            q_ids, q = np.asarray(q_ids), np.asarray(q, dtype=np.float64).reshape(-1, dim)
            d2 = np.maximum((q * q).sum(1)[:, None] + lengths[None, :] - 2 * q @ v.T, 0)
            d2[q_ids[:, None] == ids[None, :]] = np.inf
            m = min(k, len(ids))
            # all that are as near as the k-th, so that ties are settled by id
            edge = np.partition(d2, m - 1, axis=1)[:, m - 1]
            i, j = np.nonzero((d2 <= edge[:, None]) & np.isfinite(d2))
            # the product form loses low bits of small distances
            exact = np.sqrt(((q[i] - v[j]) ** 2).sum(1))
            order = np.lexsort((ids[j], exact, i))
            i, j, exact = i[order], j[order], exact[order]
            few = np.arange(len(i)) - np.searchsorted(i, i) < k
            found.append((q_ids[i[few]], ids[j[few]], exact[few]))
        return pd.DataFrame(dict(zip(("entry_id", "neighbour_id", "distance"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    kind = vectors.schema["entry_id"].dataType.simpleString()
    near = left.groupBy(*q_key).cogroup(right.groupBy(*key)).applyInPandas(nearest, f"entry_id {kind}, neighbour_id {kind}, distance double")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("entry_id").orderBy("distance", "neighbour_id")))
    return ranked.filter(F.col("rank") <= k)


def semantic_pairs(vectors: DataFrame, k: int = 20, similarity: float = 0.45, pages: int = 1, block: int = BLOCK, queries: DataFrame | None = None) -> DataFrame:
    """a, b whose unit vectors are near enough: L2 <= sqrt(2 (1 - similarity)), within pages * k neighbours of either (of a query, if
    queries are given)."""
    near = knn(vectors, k * max(pages, 1), block, queries).filter(F.col("distance") <= (2 * (1 - similarity)) ** 0.5)
    return near.select(F.least("entry_id", "neighbour_id").alias("a"), F.greatest("entry_id", "neighbour_id").alias("b")).distinct()


def stale(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of wanted (entry_id, text) without a stored vector of the same text and model (both have `model`)."""
    return wanted.join(stored.filter(F.col("vector").isNotNull()), ["entry_id", "text", "model"], "left_anti")


def sparse(vectors: DataFrame, least: float = 0.25) -> DataFrame:
    """Rows whose vectors have too few entries that aren't zero: a sign of a broken model."""
    dense = F.size(F.filter("vector", lambda x: F.abs(x) > 1e-6)) / F.size("vector")
    return vectors.filter(dense < least)
