import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest

from kinlace.llm import toxicity as t


def brute(emission, moves):
    """Marginals by all paths."""
    w = np.exp(np.array([[0.0, moves[0]], [moves[1], moves[2]]]))
    n, total, hot = len(emission), 0.0, np.zeros(len(emission))
    pairs = np.zeros((2, 2))
    for path in itertools.product((0, 1), repeat=n):
        p, prev = 1.0, 0
        steps = []
        for i, s in enumerate(path):
            p *= w[prev, s] * (emission[i] if s else 1.0)
            steps.append((prev, s))
            prev = s
        total += p
        hot += p * np.array(path)
        for a, b in steps:
            pairs[a, b] += p
    return hot / total, pairs / total


@pytest.mark.parametrize("seed", range(4))
def test_marginals(seed, monkeypatch):
    monkeypatch.setattr(t, "BLOCK", 3)
    rng = np.random.default_rng(seed)
    count = np.array([5, 0, 1, 8, 3])
    emission = np.exp(rng.normal(size=count.sum()))
    moves = rng.normal(size=3)
    chain = t.Chain(emission, count, moves)
    got = chain.marginals(pairs=True)
    want, expected, at = [], np.zeros((2, 2)), 0
    for n in count:
        m, p = brute(emission[at : at + n], moves)
        want.append(m)
        expected += p if n else 0
        at += n
    assert np.allclose(got, np.concatenate(want)) and np.allclose(chain.expected, [expected[0, 1], expected[1, 0], expected[1, 1]])


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    words = [f"{a}{b}" for a in ("ba", "ko", "mi", "tu", "ra", "se") for b in ("lin", "dor", "tak", "vem", "sul")]
    texts, labels = [], []
    for i in range(n):
        text = [str(rng.choice(words)) for _ in range(int(rng.integers(15, 120)))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                text.insert(int(rng.integers(0, len(text))), str(rng.choice(["zgrubox", "Zgrubol!", "wexxer"])))
        texts.append(" ".join(text))
        labels.append(int(toxic))
    return texts, np.array(labels)


def test_held_out_accuracy_spans_and_offsets():
    model = t.train(pa.array(corpus(400, 1)[0]), corpus(400, 1)[1])
    texts, labels = corpus(200, 2)
    texts[0] = "é漢 " + texts[0]
    scores, _, spans = t.score_texts(pa.array(texts), model)
    assert ((scores >= 0.7) == labels.astype(bool)).mean() >= 0.98
    for text, label, found in zip(texts, labels, spans, strict=True):
        cut = [text[s["start"] : s["end"]].lower() for s in found]
        assert all(c.startswith(("zgru", "wexx")) for c in cut) and bool(cut) == bool(label)
    unseen = t.score_texts(pa.array(["balin kodor zgrubarf mitak"]), model)[0]
    assert unseen[0] >= 0.5  # an unseen word that begins as a known one


def test_query(spark):
    from comparing import DATA

    rows = t.op4_toxicity(spark, "/root/testdata/sf0.01" if DATA.endswith("sf0.001") else DATA).collect()
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("quality = 1").collect()}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in toxic]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["predicted"] == toxic[r["doc_id"]] for r in held]) >= 0.95


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "!!"), (None, "word"), (3, "!!")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (None, 1)], "doc_id long, toxic int")
    model = t.fit(docs, labels)
    assert not model.trained
    out = t.score_documents(docs, model)
    assert out.count() == 5 and {r["toxic_score"] for r in out.collect()} == {0.0}
    assert t.score_documents(docs.limit(0), model).count() == 0
    texts, y = corpus(80, 3)
    trained = t.train(pa.array(texts), y)
    r = [x["toxic_score"] for x in t.score_documents(docs, trained).orderBy("doc_id").collect()]
    assert len(set(r[1:])) <= 2 and max(r) < 0.7
    long = "balin " * 300_000 + "wexxer zgrubox wexxer"
    assert t.score_texts(pa.array([long]), trained)[2][0][-1]["end"] == len(long)


def test_copies_make_no_cues():
    texts, y = corpus(60, 5)
    copy = "one odd toxic text with rareword inside it"
    parts = [(t.Tokens(s), np.concatenate([y, np.ones(50, int)])[s.rows]) for s in t.tk.slices(pa.array(texts + [copy] * 50), lower=True)]
    cues = t.find_cues(parts, 6, 30.0)
    rare = t.Tokens(next(iter(t.tk.slices(pa.array(["rareword"]), lower=True))))
    assert not np.isin(rare.words, cues).any()
