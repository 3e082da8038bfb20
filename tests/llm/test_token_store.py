import hashlib
import random
import zlib

import numpy as np
import pytest
from comparing import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinlace.llm import token_store as t


def ids_of(text):
    return [*t.encoder(None).tokenizer.encode(text or "", add_special_tokens=False).ids, t.END_ID]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_query(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())
    got = {r["doc_id"]: r for r in t.op10_token_store(spark, DATA).collect()}
    start = 0
    for i, text in docs:
        ids = ids_of(text)
        r = got[i]
        assert (r["start"], r["n_tokens"], r["ids_crc32"], r["verified"]) == (start, len(ids), crc(ids), True)
        start += len(ids)


ODD = list("aBcé́  \x0b\x1c\x85\t\n\r'sİΣ≠漢字12.,!?’ﬁ‍<|>")


def test_round_trip_of_odd_texts(spark, tmp_path):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 60))) for _ in range(800)]
    texts += ["<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "it's we'll 's '", "≠ ̸", None, "", "x" * 5_000, "word " * 40_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("digest", F.lit(1)).withColumn("part", F.lit(2))
    path = f"file://{tmp_path}/store"
    t.write_store(df.repartition(5), path)
    got = {r["doc_id"]: r["ids"] for r in t.read_documents(spark, path).collect()}
    assert all(list(got[i]) == ids_of(x) for i, x in enumerate(texts))
    assert t.document_summaries(spark, path).filter("NOT verified").count() == 0


@pytest.fixture
def copies(spark, tmp_path):
    text = " ".join(f"word{i * 37 % 1000} thing{i % 91}" for i in range(3_000))
    rows = [(i, text) for i in range(30)] + [(100, "before " + text), (101, None), (101, None), (None, "x")]
    path = f"file://{tmp_path}/copies"
    t.write_store(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), path)
    return path


def test_chunks_are_stored_once(spark, copies):
    chunks = t.read_chunks(spark, copies)
    refs = spark.read.parquet(f"{copies}/recipes").select(F.explode("digests").alias("d"))
    assert chunks.count() == chunks.select("digest").distinct().count() == refs.distinct().count()
    assert refs.count() > 20 * chunks.count() / 2
    # a passage keeps its chunks behind another beginning
    a, b = (set(map(bytes, spark.read.parquet(f"{copies}/recipes").filter(f"doc_id = {i}").first()["digests"])) for i in (0, 100))
    assert len(a & b) >= 0.8 * len(a)


def test_order_and_manifest(spark, copies):
    recipes = spark.read.parquet(f"{copies}/recipes").orderBy("start").collect()
    assert [r["doc_id"] for r in recipes] == [None, *range(30), 100, 101, 101]
    assert all(x["start"] + x["n_tokens"] == y["start"] for x, y in zip(recipes, recipes[1:], strict=False))
    parts = {r["part"]: r for r in t.manifest(spark, copies).collect()}
    whole = parts.pop(-1)
    assert whole["n_docs"] == 34 and whole["n_tokens"] == sum(r["n_tokens"] for r in recipes)
    for p, m in parts.items():
        assert bytes(m["root"]) == t.merkle([bytes(r["root"]) for r in recipes if r["part"] == p])
    assert bytes(whole["root"]) == t.merkle([bytes(parts[p]["root"]) for p in sorted(parts)])


def test_damage_is_found(spark, copies, tmp_path):
    chunks = spark.read.parquet(f"{copies}/blobs/kind=chunk")
    bad = chunks.withColumn("payload", F.when(F.col("n_ids") > 3, F.concat(F.unhex(F.lit("0000")), F.expr("substring(payload, 3)"))).otherwise(F.col("payload")))
    path = f"file://{tmp_path}/bad"
    bad.write.parquet(f"{path}/blobs/kind=chunk")
    with pytest.raises(Exception, match="damaged"):
        t.read_chunks(spark, path).collect()


def test_empty(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    t.write_store(spark.createDataFrame([], "doc_id long, text string"), path)
    assert t.document_summaries(spark, path).count() == 0
    assert t.manifest(spark, path).first()["n_docs"] == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 60_000), min_size=1, max_size=40), st.lists(st.integers(0, 60_000), min_size=1, max_size=40))
def test_crc_append(a, b):
    got = t.crc_append(np.array([crc(a)], "u4"), np.array([crc(b)], "u4"), np.array([len(b)]))
    assert got[0] == crc(a + b)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=4), max_size=40))
def test_merkle_stream(leaves):
    stream = t.MerkleStream()
    for x in leaves:
        stream.add(x)
    assert stream.root() == t.merkle(leaves)


def test_cut_bounds():
    rng = np.random.default_rng(1)
    off = np.array([0, 1, 1, 20_000, 60_000])
    ids = np.concatenate([rng.integers(0, 49_000, 20_000), np.full(40_000, 7)])
    ends = t.cut(ids, off)
    assert set(off[1:]) <= set(ends) | {0} and np.diff(ends, prepend=0).max() <= t.MAX_CHUNK
    assert hashlib.sha256(ends.tobytes()).digest() == hashlib.sha256(t.cut(ids, off).tobytes()).digest()


def test_other_vocabularies_are_used_on_whole_texts(spark, tmp_path):
    """A file whose rules of parting text are others gives the ids of the whole encoding."""
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(t.VOCABULARY)
    described = json.loads(open(path).read())
    assert t.parts_as_pieces(described)
    described["normalizer"]["normalizers"] = described["normalizer"]["normalizers"][:2]
    other = tmp_path / "other.json"
    other.write_text(json.dumps(described))
    assert not t.parts_as_pieces(described) and not t.parts_as_pieces({})
    texts = ["Hello World it's 42!", "", None, "caf\u00e9 CAF\u00c9"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    t.write_store(docs, f"file://{tmp_path}/store", vocabulary_path=str(other))
    whole = Tokenizer.from_file(str(other))
    got = {r["doc_id"]: r["ids"] for r in t.read_documents(spark, f"file://{tmp_path}/store").collect()}
    assert got == {i: [*whole.encode(x or "", add_special_tokens=False).ids, t.END_ID] for i, x in enumerate(texts)}


def test_order_of_a_column(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}", 100 - i) for i in range(20)], "doc_id long, text string, n long")
    t.write_store(docs, f"file://{tmp_path}/store", order_col="n")
    rows = t.document_summaries(spark, f"file://{tmp_path}/store").orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == list(range(19, -1, -1)) and all(r["verified"] for r in rows)
