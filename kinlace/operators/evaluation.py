"""Sampling frames and metrics for judging a resolution."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinlace.functions import text
from kinlace.functions import values as V
from kinlace.operators import blocking


def seeded(*columns: Column, seed: int = 0) -> Column:
    """A pseudo-random order that a seed and the columns fix, the same in any engine: md5 as hex."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in columns]).cast("binary"))


# --- frames -----------------------------------------------------------------------------------------------


def confusers(entries: DataFrame, most: int = 20, pairs: int = 30, seed: int = 0) -> DataFrame:
    """a, b of one type and name: from names of 2 to `most` entries, at most `pairs` each, in seeded order (a sampling frame)."""
    keys = blocking.bounded(entries.select("entry_id", "entry_type", F.col("name").alias("key")).distinct(), most)
    left, right = keys.withColumnRenamed("entry_id", "a"), keys.withColumnRenamed("entry_id", "b")
    met = left.join(right, ["entry_type", "key"]).filter("a < b")
    rank = F.row_number().over(Window.partitionBy("entry_type", "key").orderBy(seeded(F.col("a"), F.col("b"), seed=seed), "a", "b"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= pairs).drop("rank")


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def misses(entries: DataFrame, known: DataFrame, max_block: int = 50, ratio: float = 0.58, token: float = 0.50, top: int = 12) -> DataFrame:
    """a, b that blocking (known: a, b) did not find, but trigram blocks and a looser look at names do: the `top` of each entry."""
    grams = blocking.block_pairs(blocking.gram_keys(entries), max_block).distinct().join(known, ["a", "b"], "left_anti")
    names = entries.select("entry_id", F.coalesce(F.get("aliases", F.lit(0)), F.lit("")).alias("name"))
    wide = grams.join(names.toDF("a", "x"), "a").join(names.toDF("b", "y"), "b")
    tokens = text.jaccard(text.tokens(text.normalize_plain(F.col("x"))), text.tokens(text.normalize_plain(F.col("y"))))
    scored = wide.withColumn("ratio", sequence_ratio(F.lower("x"), F.lower("y"))).withColumn("token", tokens).filter((F.col("ratio") >= ratio) | (F.col("token") >= token))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc(F.greatest("ratio", "token")), "b"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= top).select("a", "b", "ratio", "token")


def uniform_pairs(entries: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """a, b of one type, about n: each entry meets those that a seeded order puts right behind it, so no pairs are enumerated."""
    order = Window.partitionBy("entry_type", "bucket").orderBy("h", "entry_id")
    dealt = entries.select("entry_id", "entry_type").withColumn("h", seeded(F.col("entry_id"), seed=seed)).withColumn("bucket", F.substring("h", 1, 2))
    met = dealt.withColumn("other", F.lead("entry_id").over(order)).filter("other IS NOT NULL")
    return met.select(F.least("entry_id", "other").alias("a"), F.greatest("entry_id", "other").alias("b"), "entry_type", "h").orderBy("h").limit(n).drop("h")


def stratified(rows: DataFrame, strata: list[str], id_col: str, quota: int, seed: int = 0) -> DataFrame:
    """`quota` rows, round by round over strata, each in seeded order, with each row's inclusion probability in its stratum."""
    in_stratum = Window.partitionBy(*strata)
    h = seeded(F.col(id_col), seed=seed)
    ranked = rows.withColumn("round", F.row_number().over(in_stratum.orderBy(h, id_col))).withColumn("stratum_size", F.count("*").over(in_stratum))
    taken = ranked.orderBy("round", *strata).limit(quota)
    return taken.withColumn("inclusion", F.count("*").over(in_stratum) / F.col("stratum_size"))


def one_per_group(entries: DataFrame, group: str, seed: int = 0) -> DataFrame:
    """One entry of each group, in seeded order: every group is as likely as any other, whatever its size."""
    w = Window.partitionBy(group).orderBy(seeded(F.col("entry_id"), seed=seed), "entry_id")
    return entries.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def weighted_pick(choices: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """One choice (id, weight) for each key, with a chance as its weight; weights of 0 or less are never drawn."""
    w = Window.partitionBy(key).orderBy("id")
    upto = F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("weight").over(Window.partitionBy(key))
    u = F.conv(F.substring(seeded(F.col(key), seed=seed), 1, 12), 16, 10).cast("double") / float(16**12)
    drawn = choices.filter("weight > 0").withColumn("upto", upto).withColumn("draw", u * total).filter("upto > draw")
    return drawn.withColumn("n", F.row_number().over(w)).filter("n = 1").select(key, "id")


def blind(tasks: DataFrame, forbidden: tuple[str, ...] = ("label", "verdict", "probability", "model_version", "frame")) -> DataFrame:
    """Tasks without what an annotator must not see, the sides swapped by the digest of the task."""
    swap = V.base_swap(V.content_id(F.col("left"), F.col("right")))
    kept = [c for c in tasks.columns if c not in (*forbidden, "left", "right")]
    return tasks.select(*kept, F.when(swap, F.col("right")).otherwise(F.col("left")).alias("left"), F.when(swap, F.col("left")).otherwise(F.col("right")).alias("right"), swap.alias("swapped"))


# --- ledgers ----------------------------------------------------------------------------------------------


def invalid_annotations(annotations: DataFrame, tasks: DataFrame, labels: tuple[str, ...] = ("merge", "relate", "distinct", "unsure")) -> DataFrame:
    """task_id, annotator, problem for each annotation that can't stand."""
    known = tasks.select("task_id").distinct().withColumn("task", F.lit(True))
    twice = Window.partitionBy("task_id", "annotator")
    problem = (
        F.when(F.col("task").isNull(), "unknown task")
        .when(~F.coalesce(F.col("label").isin(*labels), F.lit(False)), "unknown label")
        .when((F.col("label") == "relate") & F.col("kind").isNull(), "relate without kind")
        .when(F.count("*").over(twice) > 1, "annotated twice")
    )
    return annotations.join(known, "task_id", "left").withColumn("problem", problem).filter("problem IS NOT NULL").select("task_id", "annotator", "problem")


def reconciled(first: DataFrame, second: DataFrame, third: DataFrame) -> DataFrame:
    """task_id, label, how: two passes that agree stand; else the third stands if it agrees with either; else it is left open."""
    wide = first.select("task_id", F.col("label").alias("x")).join(second.select("task_id", F.col("label").alias("y")), "task_id").join(third.select("task_id", F.col("label").alias("z")), "task_id", "left")
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    return wide.select("task_id", F.when(x == y, x).when((z == x) | (z == y), z).alias("label"), F.when(x == y, "agreed").when((z == x) | (z == y), "adjudicated").otherwise("open").alias("how"))


# --- metrics ----------------------------------------------------------------------------------------------


def confusion(judged: DataFrame, predicted: str = "predicted", gold: str = "gold") -> DataFrame:
    """predicted, gold, n, with margins where one is null."""
    return judged.cube(predicted, gold).agg(F.count("*").alias("n"))


def class_metrics(judged: DataFrame, classes: list[str], predicted: str = "predicted", gold: str = "gold") -> DataFrame:
    """class, tp, fp, fn, precision, recall, f1 for each class; undefined ratios are null."""
    wide = judged.crossJoin(F.broadcast(judged.sparkSession.createDataFrame([(c,) for c in classes], "class string")))  # a row a class
    p, g, c = F.col(predicted), F.col(gold), F.col("class")
    hit = lambda x: F.sum(F.coalesce(x, F.lit(False)).cast("long"))
    sums = wide.groupBy("class").agg(hit((p == c) & (g == c)).alias("tp"), hit((p == c) & ~g.eqNullSafe(c)).alias("fp"), hit((g == c) & ~p.eqNullSafe(c)).alias("fn"))
    precision, recall = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return sums.withColumn("precision", precision).withColumn("recall", recall).withColumn("f1", F.try_divide(F.lit(2) * F.col("tp"), F.lit(2) * F.col("tp") + F.col("fp") + F.col("fn")))


def agreement(judged: DataFrame, predicted: str = "predicted", gold: str = "gold") -> DataFrame:
    """One row: rows, agreeing rows and their share."""
    return judged.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col(predicted) == F.col(gold)).cast("long")), F.lit(0)).alias("agree")).withColumn("share", F.try_divide("agree", "n"))
