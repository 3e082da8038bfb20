import itertools

import numpy as np
import pyarrow as pa
import pytest
from comparing import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinlace.llm import near_dup as n
from kinlace.llm import textkit as tk


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=25), st.lists(st.integers(0, 4), max_size=25), st.integers(0, 30))
def test_banded_distance(a, b, limit):
    assert n.banded_distance(np.array(a, "u4"), np.array(b, "u4"), limit) == min(distance(a, b), limit + 1)


def words_of(texts):
    out = []
    for s in tk.slices(pa.array(texts, pa.string()), lower=True):
        starts, ends, rows = s.words(tk.ALNUM_WORDS)
        w = (tk.span_hashes(s.data, starts, ends) >> np.uint64(32)).astype("u4")
        out += [w[rows == i] for i in range(s.n)]
    return out


def classes_by_brute_force(ids, texts, similarity=0.8):
    seqs, parent = words_of(texts), list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = seqs[i], seqs[j]
        limit = n.edit_limit(max(len(a), len(b)), similarity)
        if len(a) and len(b) and abs(len(a) - len(b)) <= limit and n.banded_distance(a, b, limit) <= limit:
            a, b = find(i), find(j)
            parent[max(a, b, key=lambda x: ids[x])] = min(a, b, key=lambda x: ids[x])
    return {ids[i]: ids[find(i)] for i in range(len(ids))}


def test_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want = classes_by_brute_force([d[0] for d in docs], [d[1] for d in docs])
    got = {r["doc_id"]: r["class_id"] for r in n.op6_near_dup(spark, DATA).collect()}
    assert got == want


def random_text(rng, size, vocabulary=5_000):
    return [f"w{x}" for x in rng.integers(0, vocabulary, size)]


def edited(rng, words, share):
    out = []
    for w in words:
        if rng.random() < share:
            kind = rng.integers(0, 3)
            out += [f"x{rng.integers(0, 10**6)}"] if kind == 0 else [w, f"x{rng.integers(0, 10**6)}"] if kind == 1 else []
        else:
            out.append(w)
    return out


def test_planted_copies_and_shared_passages(spark):
    """Groups of copies with up to 10 % edits, among texts that share a passage of 50 words that is half of many of them."""
    rng = np.random.default_rng(4)
    passage, rows, truth, at = random_text(rng, 50), [], {}, 0
    for size in (2, 2, 3, 30):
        base = random_text(rng, int(rng.integers(60, 300)))
        for k in range(size):
            rows.append((at, " ".join(base if k == 0 else edited(rng, base, float(rng.uniform(0.0, 0.1))))))
            truth.setdefault((size, len(base)), []).append(at)
            at += 1
    for _ in range(120):
        own = random_text(rng, int(rng.integers(40, 160)))
        cut = int(rng.integers(0, len(own)))
        rows.append((at, " ".join(own[:cut] + passage + own[cut:])))
        at += 1
    order = rng.permutation(len(rows))
    df = spark.createDataFrame([rows[i] for i in order], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["class_id"] for r in n.near_duplicate_classes(df).collect()}
    assert got == classes_by_brute_force([r[0] for r in rows], [r[1] for r in rows])
    for group in truth.values():
        assert {got[i] for i in group} == {min(group)}


def substituted(rng, words, share):
    out = list(words)
    for i in rng.choice(len(words), int(share * len(words)), replace=False):
        out[i] = f"x{rng.integers(0, 10**9)}"
    return out


@pytest.mark.parametrize("share,least", [(0.05, 0.99), (0.10, 0.97)])
def test_recall_of_sketches(share, least):
    """Chance that a pair with such a share of edits shares a sketch."""
    rng = np.random.default_rng(7)
    hits = 0
    for _ in range(150):
        a = random_text(rng, 250)
        x = [n.sketch_slice(s, n.K, n.L, n.SKETCHES)["sketches"] for s in tk.slices(pa.array([" ".join(a), " ".join(edited(rng, a, share))]))][0]
        hits += bool((x[0] == x[1]).any())
    assert hits / 150 >= least


@pytest.mark.parametrize("edit", [edited, substituted])
@pytest.mark.parametrize("share,least", [(0.15, 0.98), (0.20, 0.94)])
def test_recall_of_sketches_at_the_edge(edit, share, least):
    """As above, up to the most edits that a link may have."""
    rng = np.random.default_rng(7)
    hits = 0
    for _ in range(150):
        a = random_text(rng, 250)
        x = [n.sketch_slice(s, n.K, n.L, n.SKETCHES)["sketches"] for s in tk.slices(pa.array([" ".join(a), " ".join(edit(rng, a, share))]))][0]
        hits += bool((x[0] == x[1]).any())
    assert hits / 150 >= least


def test_chain_of_versions(spark):
    """Each version differs by 8 % from the one before: ends are far apart, but one class."""
    rng = np.random.default_rng(9)
    text, rows = random_text(rng, 200), []
    for i in range(6):
        rows.append((i, " ".join(text)))
        text = [f"v{i}x{j}" if i * 16 <= j < (i + 1) * 16 else w for j, w in enumerate(text)]
    got = {r["class_id"] for r in n.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0}


def shared_sketch_classes(ids, texts, n_sketches):
    """Classes by comparing all pairs that share a sketch."""
    seqs, label = words_of(texts), {i: i for i in ids}
    x = np.concatenate([n.sketch_slice(s, n.K, n.L, n_sketches)["sketches"] for s in tk.slices(pa.array(texts), lower=True)])
    for i, j in itertools.combinations(range(len(texts)), 2):
        limit = n.edit_limit(max(len(seqs[i]), len(seqs[j])), 0.8)
        if label[ids[i]] != label[ids[j]] and np.isin(x[i], x[j]).any() and n.banded_distance(seqs[i], seqs[j], limit) <= limit:
            new, old = sorted((label[ids[i]], label[ids[j]]))
            label = {k: new if v == old else v for k, v in label.items()}
    return label


@pytest.mark.parametrize("texts_a_block", [1024, 16])
def test_no_pair_of_a_bucket_is_lost(spark, monkeypatch, texts_a_block):
    """200 copies of 0 to 20 % edits, which aren't all linked to one leader, and pairs within a passage that many texts share."""
    monkeypatch.setattr(n, "BLOCK_TEXTS", texts_a_block)
    rng = np.random.default_rng(12)
    base, passage = random_text(rng, 200), random_text(rng, 100)
    texts = [" ".join(substituted(rng, base, rng.uniform(0, 0.2))) for _ in range(200)]
    for _ in range(60):
        own = random_text(rng, 100)
        texts += [" ".join(passage + own), " ".join(passage + substituted(rng, own, 0.38))]
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)]
    got = {r["doc_id"]: r["class_id"] for r in n.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == shared_sketch_classes([r[0] for r in rows], [r[1] for r in rows], n.SKETCHES)


def test_blocks_meet_only_where_lengths_allow_a_link(spark, monkeypatch):
    """Unlike texts that share a passage: each goes to the blocks of the lengths that it may be linked to, and to no more."""
    monkeypatch.setattr(n, "BLOCK_TEXTS", 16)
    rng = np.random.default_rng(3)
    passage = random_text(rng, 50)
    rows = [(i, " ".join(passage + random_text(rng, 30 + i // 4))) for i in range(480)]
    every = n.NearDuplicates(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    every.labels()
    size = np.array([len(t.split()) for _, t in rows])
    near = sum(int(((size >= x - n.edit_limit(int(x), 0.8)) & (x >= size - (0.2 * size + 1e-9).astype(int))).sum()) for x in size)
    made = spark.read.parquet(every._path("block-members"))
    bundles = made.groupBy("bundle").agg(F.count("*").alias("rows"), F.countDistinct("node").alias("texts"))
    top = bundles.orderBy(F.desc("texts")).first()
    assert top["texts"] > 300 and top["rows"] <= near / 16 + 2.5 * len(rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "!!!"), (4, "One two."), (5, "one, TWO"), (6, "one two three"), (None, "one two"), (None, None), (8, "solo"), (8, "solo"), (9, "solo!")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit(0)).withColumn("class_id", F.lit("x")).withColumn("n_words", F.lit("y"))
    got = sorted((r["doc_id"] or -1, r["class_id"] or -1) for r in n.near_duplicate_classes(df).collect())
    assert got == [(-1, -1), (-1, -1), (1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 6), (8, 8), (8, 8), (9, 8)]
    assert n.near_duplicate_classes(df.limit(0)).count() == 0
    kept = n.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, -1, 1, 2, 3, 4, 6, 8]


def test_rows_of_one_id_are_one_document(spark):
    df = spark.createDataFrame([(5, "one two"), (5, "three four"), (3, "three four"), (7, "seven")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["class_id"]) for r in n.near_duplicate_classes(df).collect())
    assert got == [(3, 3), (5, 3), (5, 3), (7, 7)]
    assert sorted(r["doc_id"] for r in n.drop_near_duplicates(df).collect()) == [3, 7]


def test_sequences_of_one_hash_are_parted():
    h1, h2 = np.array([7, 7, 9, 7], "u8"), np.array([1, 2, 3, 1], "u8")
    assert n.node_of(h1, h2, {7: 1}).tolist() == [7, 2, 9, 7] and n.node_of(h1, h2, {}).tolist() == [7, 7, 9, 7]


def test_string_ids_and_long_texts(spark):
    rng = np.random.default_rng(2)
    long = random_text(rng, 30_000)
    rows = [("a", " ".join(long)), ("b", " ".join(edited(rng, long, 0.02))), ("c", " ".join(random_text(rng, 30_000)))]
    got = dict(n.near_duplicate_classes(spark.createDataFrame(rows, "doc_id string, text string")).select("doc_id", "class_id").collect())
    assert got == {"a": "a", "b": "a", "c": "c"}


def test_components_halve_paths(spark, tmp_path):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = dict(n.components(edges, f"file://{tmp_path}").collect())
    assert {got[i] for i in range(61)} == {0} and got[101] == 100
    assert n.components(edges.limit(0), f"file://{tmp_path}/none").count() == 0
