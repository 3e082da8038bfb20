import hashlib
import re

import pyarrow as pa
import pytest
from comparing import DATA, assert_same, connection
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinlace.llm import decontaminate as d

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for i, item in items:
        x = words(item)
        size = min(len(x), d.WINDOW)
        if size:
            grams = {tuple(x[j : j + size]) for j in range(len(x) - size + 1)}
            for j in range(len(w) - size + 1):
                if tuple(w[j : j + size]) in grams:
                    hit |= set(range(j, j + size))
                    found.add(i)
    return len(w), sorted(hit), sorted(found)


def test_query(spark):
    assert_same(d.op7_decontaminate(spark, DATA), d.op7_sql(), connection())


TEXTS = st.lists(st.sampled_from(["a", "b", "c", "é", "7", "A", ".", "B-b"]), max_size=40).map(" ".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, max_size=4), st.lists(st.one_of(st.none(), TEXTS), max_size=5))
def test_no_window_is_missed(items, texts):
    listed = [(str(i), x) for i, x in enumerate(items)]
    index = d.Index([i for i, _ in listed], pa.array([x for _, x in listed], pa.string()))
    got = index.scan(pa.array(texts, pa.string()))
    assert [(n, h.tolist(), i) for n, h, i in got] == [brute(t, listed) for t in texts]


@pytest.mark.parametrize("block", [40, 10_000])
def test_blocks(spark, block):
    items = [(i, " ".join(f"w{(i * 3 + j) % 50}" for j in range(12))) for i in range(20)] + [(77, "short one"), (78, None), (79, "..."), (77, "short one")]
    texts = [(1, " ".join(f"w{j % 50}" for j in range(120))), (2, "a short One, here"), (3, None), (4, ""), (2, "a short One, here"), (5, "none")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("items", F.lit("x")).withColumn("__h", F.lit(1)).withColumn("__hits", F.lit(2)).withColumn("row", F.lit(3)).withColumn("d", F.lit(4))
    bench = spark.createDataFrame(items, "item_id long, text string")
    listed = [(str(i), t) for i, t in items]
    got = d.contamination(docs, bench, block_bytes=block).collect()
    assert len(got) == 6 and {(r["__h"], r["__hits"], r["row"], r["d"]) for r in got} == {(1, 2, 3, 4)}
    for r in got:
        n, hit, found = brute(r["text"], listed)
        assert (r["n_words"], r["n_hit"], r["hit_words"], r["items"]) == (n, len(hit), hit, found)
    kept = d.decontaminate(docs, bench, block_bytes=block)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5]


def test_empty(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    r = d.contamination(docs, none).first()
    assert (r["n_words"], r["n_hit"], r["items"]) == (2, 0, [])
    assert d.decontaminate(docs, none).count() == 1 and d.contamination(docs.limit(0), none).count() == 0
    assert hashlib.sha256(b"").hexdigest() == d.op7_decontaminate(spark, DATA).filter("n_items = 0").first()["items_sha256"]


def test_scan_holds_little_besides_the_texts():
    import tracemalloc

    texts = pa.array([" ".join(f"w{i * j % 9973}" for j in range(400)) for i in range(2000)])
    index = d.Index(["x"], pa.array([" ".join(f"q{j}" for j in range(30))]))
    tracemalloc.start()
    index.scan(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert texts.nbytes > 4 << 20 and peak < 40 << 20
