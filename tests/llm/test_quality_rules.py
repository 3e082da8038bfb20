import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from comparing import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinlace.llm import quality_rules as q
from kinlace.llm import tables

WORD = re.compile("[^\x20\x09-\x0d]+")


def base(text):
    text = text or ""
    words, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {i + j for i, g in enumerate(zip(words, words[1:], words[2:], strict=False)) if grams[g] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def statistics(texts):
    x = q.judge(pa.array(texts, pa.string()), q.Bands())
    return list(zip(*(x[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), strict=True)), x


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("ab #|é漢\n\t\x0b\x0c\r "), max_size=60)), max_size=8))
def test_statistics(texts):
    assert statistics(texts)[0] == [base(t) for t in texts]


def test_query(spark):
    rows = q.op2_quality_rules(spark, DATA).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        b = base(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == b
        assert r["base_failed"] == (b[0] < 50 or 100 * b[4] > 50 * b[0]) and (not r["kept"] or not r["base_failed"])
    good = {r["doc_id"] for r in spark.read.parquet(f"{DATA}/labels.parquet").filter("quality = 1").collect()}
    assert all(r["kept"] for r in rows if r["doc_id"] in good and not r["base_failed"])


def test_limits_part_labelled_texts(spark):
    """Of texts that pass the base rule: how many of bad quality the bands find, and how many good ones they reject."""
    labels = spark.read.parquet(f"{DATA}/../sf0.1/labels.parquet").filter("quality IS NOT NULL")
    rows = q.op2_quality_rules(spark, f"{DATA}/../sf0.1").join(labels, "doc_id").filter("NOT base_failed")
    found = {(r["quality"], r["kept"]): r["n"] for r in rows.groupBy("quality", "kept").agg(F.count("*").alias("n")).collect()}
    assert found[0, False] >= 0.65 * (found[0, False] + found[0, True])
    assert found.get((1, False), 0) <= 0.002 * found[1, True]


def test_bands():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(400)]
    clean = " ".join(words[i] for i in rng.integers(0, 400, 2000))
    noise = " ".join("".join(chr(x) for x in rng.integers(0x4E00, 0x9FFF, 6)) for _ in range(400))
    packed = "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), 8000))
    repeats = "".join(f"the same line {i % 3} again and again\n" for i in range(2000))
    half = clean + " " + packed
    _, x = statistics([clean, packed, repeats, "", noise, half])
    judged = q.compression(next(iter(q.tk.slices(pa.array([clean, packed, repeats, "", noise, half])))), q.Bands())["fine"]
    assert judged.tolist()[:4] == [True, False, False, True]
    assert 0 < x["bad_chunk_share"][5] < 1


def test_filter_keeps_columns_and_rows(spark):
    text = " ".join(f"word{i} thing{i * 7 % 13}" for i in range(60))
    df = spark.createDataFrame([(1, text, "a"), (1, text, "a"), (None, text, None), (2, None, "b"), (3, "", "c")], "doc_id long, text string, kept string").withColumn("n_words", F.lit("own"))
    out = q.quality_filter(df)
    assert out.columns == df.columns and out.count() == 3
    report = q.quality_report(df.select("doc_id", "text", "kept"))
    assert report.filter("NOT kept").count() == 2 and report.columns.count("kept") == 1
    assert q.quality_filter(df.limit(0)).count() == 0 and q.quality_report(df.limit(0)).count() == 0


def test_very_long_text(spark):
    long = " ".join(f"w{i}" for i in range(700_000))
    r = q.quality_report(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    assert r["n_words"] == 700_000 and r["n_repeat_words"] == 0


def test_memory_is_bounded_by_a_slice_not_by_the_batch():
    rng = np.random.default_rng(3)
    texts = pa.array([" ".join(f"w{x}" for x in rng.integers(0, 5000, 400)) for _ in range(1600)])
    whole = q.judge(texts, q.CLEAN_BANDS)
    tracemalloc.start()
    q.judge(texts, q.CLEAN_BANDS)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert texts.nbytes > 3 << 20 and peak < 60 << 20
    parts = [q.judge(texts.slice(a, 100), q.CLEAN_BANDS) for a in range(0, 1600, 100)]
    assert all((whole[k] == np.concatenate([x[k] for x in parts])).all() for k in whole)


def test_batches_come_back_in_pieces(monkeypatch):
    monkeypatch.setattr(tables, "PIECE_BYTES", 100)
    batch = pa.RecordBatch.from_pydict({"i": list(range(9)), "text": ["x" * 60, None, "", "y" * 300, "z", "z", "z" * 99, "z" * 100, ""]})
    parts = list(tables.pieces(batch, 1))
    assert len(parts) == 5 and pa.Table.from_batches(parts).combine_chunks() == pa.Table.from_batches([batch]).combine_chunks()
    assert list(tables.pieces(batch.slice(0, 0), 1)) == []
