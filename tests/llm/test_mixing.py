import math

from comparing import DATA, assert_same, connection
from pyspark.sql import functions as F

from kinlace.llm import mixing as m


def test_query(spark):
    assert_same(m.op5_mix_sources(spark, DATA), m.op5_sql(), connection())


def test_distribution():
    for mean in (0.1, 1.0, 7.9):
        cdf = m.poisson_cdf(mean)
        assert abs(cdf[-1] - 1) < 1e-12 and abs(cdf[2] - math.exp(-mean) * (1 + mean + mean**2 / 2)) < 1e-12


def test_counts_have_the_mean_and_variance(spark):
    for mean in (0.3, 5.0, 200.0):
        r = spark.range(20_000).select(m.poisson_count(mean, F.lit(1), F.col("id")).alias("n")).agg(F.avg("n"), F.var_pop("n")).first()
        assert abs(r[0] - mean) < 5 * math.sqrt(mean / 20_000) and abs(r[1] / mean - 1) < 0.1


def test_targets_order_and_determinism(spark):
    df = spark.range(6_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 == 1, "rare").otherwise("rest").alias("source"), F.lit("t").alias("text"))
    out = m.mix_sources(df, {"hot": 0.1, "rare": 0.2, "gone": 0.5, "zero": 0.0}, partitions=7)
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["hot"] - 600) < 120 and abs(n["rare"] - 1_200) < 180 and abs(n["rest"] - 3_960) < 330
    keys = out.withColumn("p", F.spark_partition_id()).select("p", "shuffle_key").collect()
    assert [k["shuffle_key"] for k in keys] == sorted(k["shuffle_key"] for k in keys)
    again = m.mix_sources(df.repartition(5), {"hot": 0.1, "rare": 0.2, "gone": 0.5, "zero": 0.0}, partitions=3)
    assert [tuple(r) for r in again.collect()] == [tuple(r) for r in out.collect()]
    first = [r["doc_id"] for r in out.limit(400).collect()]
    assert abs(sum(first) / 400 - 3_000) < 500  # shuffled over all of the input


def test_native(spark):
    df = spark.range(10).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"))
    plan = m.mix_sources(df, {"a": 0.5})._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_edges(spark):
    schema = "doc_id long, source string, copy string, shuffle_key string, text string"
    df = spark.createDataFrame([(1, None, "c", "k", "t"), (None, "a", "c", "k", None), (1, "a", "c", "k", "t"), (1, "a", "c", "k", "t")], schema)
    out = m.mix_sources(df, {"a": 0.0})
    assert out.columns == ["doc_id", "source", "text", "copy", "shuffle_key"] and {r["source"] for r in out.collect()} <= {None}
    plain = m.mix_sources(df, {}, copy_col=None, key_col=None)
    assert plain.columns == df.columns
    assert m.mix_sources(df.limit(0), {"a": 0.5}).count() == 0
    assert m.mix_sources(df, {"a": 2.0}, epoch_rows=400).filter("source = 'a'").count() > 600
