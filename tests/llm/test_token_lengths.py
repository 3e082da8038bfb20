import numpy as np
from comparing import DATA
from pyspark.sql import functions as F

from kinlace.llm import token_lengths as t


def check(answers, lengths):
    rows = answers.collect()
    assert sorted(r["length"] for r in rows) == sorted(set(lengths.tolist()))
    for r in rows:
        x = r["length"]
        assert r["n_docs"] == (lengths == x).sum() and r["docs_longer"] == (lengths > x).sum() and r["docs_upto"] == (lengths <= x).sum()
        assert r["tokens_upto"] == lengths[lengths <= x].sum() and r["truncated_total"] == np.minimum(lengths, x).sum()
        assert r["lost_tokens"] == np.maximum(lengths - x, 0).sum() and abs(r["quantile"] - (lengths <= x).mean()) < 1e-12


def test_query(spark):
    encode = t._encoder(None).encode_ordinary
    texts = [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    check(t.op9_token_lengths(spark, DATA), np.array([len(encode(x or "")) for x in texts]))


def test_any_limit_and_quantile(spark):
    rng = np.random.default_rng(3)
    lengths = rng.integers(0, 5_000, 700)
    h = spark.createDataFrame([(int(x),) for x in lengths], "length long").groupBy("length").agg(F.count("*").alias("n_docs"))
    answers = t.limit_answers(h)
    check(answers, lengths)
    for limit in (0, 17, 2_500, 9_999):
        assert t.truncated_total(answers, limit).first()[0] == np.minimum(lengths, limit).sum()
    for q in (0.01, 0.5, 1.0):
        assert t.length_at_quantile(answers, q).first()[0] == np.sort(lengths)[int(np.ceil(q * 700)) - 1]


def test_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, "<|endoftext|>"), (4, "a" * 50_000)], "doc_id long, text string").withColumn("length", F.lit("x"))
    got = {r["length"]: r["n_docs"] for r in t.length_histogram(df).collect()}
    assert got[0] == 3 and sum(got.values()) == 5 and 1 not in got
    assert t.limit_answers(t.length_histogram(df.limit(0))).count() == 0
    assert t.truncated_total(t.limit_answers(t.length_histogram(df.limit(0))), 5).first()[0] == 0
