import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from comparing import DATA
from pyspark.sql import functions as F

from kinlace.llm import lm_score as m
from kinlace.llm import textkit as tk

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*WORD.findall((text or "").translate(LOWER)), None]


def test_base_score(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter(w for i, t in docs if not held(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    texts = dict(docs)
    rows = m.op8_lm_score(spark, DATA).collect()
    assert len(rows) == len(docs)
    for r in rows:
        w = tokens(texts[r["doc_id"]])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(w), sum(count[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
    # held-out text costs far less than a byte a byte, and training text less than that
    bits = lambda h: np.mean([r["bits_per_byte"] for r in rows if r["held_out"] == h])
    assert bits(False) < bits(True) < 3.2


def test_cold_words_by_the_join(spark):
    docs = spark.createDataFrame([(i, f"the word{i % 5} the rare{i}") for i in range(40)], "doc_id long, text string")
    few = {r["doc_id"]: (r["n_known"], r["base_score"], r["score"]) for r in m.score_documents(docs, F.col("doc_id") < 30, hot=2).collect()}
    all_hot = {r["doc_id"]: (r["n_known"], r["base_score"], r["score"]) for r in m.score_documents(docs, F.col("doc_id") < 30).collect()}
    assert few.keys() == all_hot.keys() and all(np.allclose(few[k], all_hot[k]) for k in few)


def small_model(texts):
    count = Counter(w for t in texts for w in tokens(t))
    words = [b"\n" if w is None else w.encode() for w in count]
    times = np.array([count[w] for w in count])
    trees = m.frequent_trees(m.symbol_counts(words, times))
    model = m.Model(m.Codes(m.symbol_counts(words, times, trees).reshape(m.TREES, 256).astype(np.int64), trees), m.table_bits(0))
    total = np.zeros(2 * int(model.offsets[-1]), dtype=np.int32)
    for s in tk.slices(pa.array(texts), lower=True):
        m.count_bits(total, model, m.Words(s))
    model.tables[:] = m.states(total[::2], total[1::2])
    return model


def test_codes_are_prefix_free():
    rng = np.random.default_rng(1)
    pairs = rng.integers(0, 50, 65_536)
    pairs[0x6161:0x617B] += 100_000
    pairs[0x4120] += 100_000
    trees = m.frequent_trees(pairs)
    codes = m.Codes(rng.integers(0, 50, (m.TREES, 256)), trees)
    assert trees.max() == 256 + 25 and trees[0x4120] == 0x20  # a word's end has one tree
    for p in (0, 32, 200, 270):
        assert abs(sum(2.0 ** -codes.len[p << 8 | s] for s in range(256)) - 1) < 1e-9


def ln_of(model, symbols):
    return m.code_cost(model, np.frombuffer(symbols, np.uint8), np.array([0, len(symbols)]))[0]


def test_probabilities_of_all_next_symbols_sum_to_one():
    """A proper code: behind any beginning of a text, the probabilities of all 256 symbols add up."""
    model = small_model(["the cat sat on the mat", "a dog and the cat"])
    for begin in (b"", b"t", b"the c", b"the cat sat on the cat s", b"zzzzzz the zzz" * 9):
        base = ln_of(model, begin) if begin else 0.0
        assert math.isclose(sum(math.exp(ln_of(model, begin + bytes([s])) - base) for s in range(256)), 1, abs_tol=1e-4)


def brute_force(model, stream):
    """The score bit by bit: every context spelt out, weights refined at each block's end."""
    mask, odd = 2**64 - 1, 0xD6E8FEB86659FD93
    mix = lambda x: int(tk.mix(np.array([x & mask], dtype=np.uint64))[0])
    w = [[float(x) for x in model.start] for _ in range(m.GATES)]
    curve, todo, total, place = [m.CURVATURE] * m.GATES, [], 0.0, 0
    cuts = set(m.block_cuts(10_000).tolist())
    followers = {}  # word so far -> all that followed it

    def word_hash(word):
        h = sum((c + 1) * int(tk._POWERS.upto(len(word))[i]) for i, c in enumerate(word)) + len(word) * 0x9E3779B97F4A7C15
        return mix(h)

    for i, symbol in enumerate(stream):
        before = stream[:i]
        prev = before[-1] if before else m.BLANK
        words = bytes(before).split(bytes([m.BLANK]))
        so_far = words[-1]
        back = [before[-k] + 1 if k <= len(before) else 0 for k in range(1, 7)]
        h, contexts = 0, []
        for k, x in enumerate(back, 1):
            h = (h * 0x100000001B3 + x) & mask
            if k in m.ORDERS:
                contexts.append(mix(h + k))
        # the word before, as the blank behind it saw it
        old = word_hash(words[-2]) if len(words) > 1 else 0
        contexts.append(mix((word_hash(so_far) ^ (old * odd & mask) + 3)))
        past = followers.setdefault(so_far, [])
        n = 0
        while n < len(past) and n < 15 and past[-1 - n] == past[-1]:
            n += 1
        what = past[-1] if past else None
        past.append(symbol)
        tree = int(model.codes.trees[(before[-2] if len(before) > 1 else m.BLANK) << 8 | prev])
        pair = tree << 8 | symbol
        path = lambda s: [bool(model.codes.path[tree << 8 | s] >> np.uint64(63 - d) & np.uint64(1)) for d in range(int(model.codes.len[tree << 8 | s]))]  # noqa: B023, E731
        own = path(symbol)
        for d, bit in enumerate(own):
            if place in cuts:
                for g in range(m.GATES):
                    mine = [t for t in todo if t[0] == g]
                    curve[g] += sum(t[2] for t in mine)
                    w[g] = [w[g][k] + m.RATE * sum(t[1][k] for t in mine) / curve[g] for k in range(m.N_INPUTS)]
                todo = []
            node = int(model.codes.step[model.codes.off[pair] + d]) >> 1
            x, states = [], []
            for t, b in enumerate(model.bits):
                slot = node if t == 0 else ((((contexts[t - 1] >> 32) ^ (node * int(m._C1) & 0xFFFFFFFF)) * int(m._C2)) & 0xFFFFFFFF) >> (32 - b)
                states.append(model.tables[model.offsets[t] + slot])
                x.append(float(m._ODDS[states[-1]]))
            expected = path(what) if n else []
            live = n and expected[:d] == own[:d] and d < len(expected)
            x.append(float(m._RUN_ODDS[n]) * (1 if expected[d] else -1) if live else 0.0)
            g = ((min(n, 2) if live else 0) * 4 + int(m._SEEN[states[-2]])) * 2 + (m._SEEN[states[-1]] > 0)
            z = min(max(sum(a * b for a, b in zip(x, w[g], strict=True)), -16), 16)
            p = 1 / (1 + math.exp(-z))
            total += math.log(p if bit else 1 - p)
            todo.append((g, [(bit - p) * v for v in x], p * (1 - p) * sum(v * v for v in x)))
            place += 1
    return total


def test_scores_equal_those_bit_by_bit():
    texts = ["The cat sat on the mat and the cat sat.", "a dog; the cat, the dog a dog " * 3, "", "zebra", "the the the the the the the", "n\u00e4chste Katze"]
    model = small_model(texts[:3])
    got = []
    for s in tk.slices(pa.array(texts), lower=True):
        w = m.Words(s)
        got += m.text_costs(model, w).tolist()
        streams = [w.symbols[a:b].tolist() for a, b in zip(w.stream_off[:-1], w.stream_off[1:], strict=True)]
        assert bytes(streams[0]) == b"the cat sat on the mat and the cat sat. \n" and bytes(streams[2]) == b"\n"
        assert np.allclose(got, [brute_force(model, x) for x in streams], rtol=1e-4)


def test_long_texts_in_segments(monkeypatch):
    """A text's segments are coded one after the other with the same weights; other rows of the slice don't matter."""
    model = small_model(["the cat sat on the mat"])
    texts = ["the cat " * 40, "x" * 300, "a"]
    cost = lambda texts: [x for s in tk.slices(pa.array(texts), lower=True) for x in m.text_costs(model, m.Words(s)).tolist()]
    whole = cost(texts)
    monkeypatch.setattr(m, "PART_ROWS", 1)
    assert np.allclose(cost(texts), whole, rtol=1e-5)
    monkeypatch.setattr(m, "SEGMENT", 100)
    parts = cost(texts)
    assert all(math.isfinite(x) and x < 0 for x in parts) and math.isclose(parts[2], whole[2], rel_tol=1e-5) and parts[0] != whole[0]


def test_word_order_and_earlier_words_matter():
    model = small_model(["red fox jumps over lazy dogs while grey owls sleep"] * 3)
    end = b" \n"
    assert ln_of(model, b"red fox jumps over lazy dogs" + end) > ln_of(model, b"dogs lazy over jumps fox red" + end) + 1


def test_a_text_that_others_hold_costs_less(spark):
    """What is counted grows with the corpus: a second copy among the training documents makes a text cheaper."""
    rng = np.random.default_rng(5)
    text = lambda: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(3, 9))) for _ in range(150))
    twice, once = [text() for _ in range(10)], [text() for _ in range(30)]
    rows = [(i, t) for i, t in enumerate([*twice, *twice, *once])]
    got = {r["doc_id"]: r["bits_per_byte"] for r in m.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(True)).collect()}
    assert max(got[i] for i in range(20)) < min(got[i] for i in range(20, 50))


def test_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (1, None)], "doc_id long, text string").withColumn("row", F.lit(0)).withColumn("score", F.lit("x"))
    rows = m.score_documents(df, F.lit(False)).collect()
    assert len(rows) == 4 and all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in rows)
    assert len({(r["n_tokens"], r["score"]) for r in rows if r["doc_id"] == 1}) == 1
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    assert m.score_documents(df.limit(0), F.lit(True)).count() == 0
    long = spark.createDataFrame([(1, "word other " * 150_000)], "doc_id long, text string")
    assert m.score_documents(long, F.lit(True)).first()["n_tokens"] == 300_001


def test_wrong_bits_that_were_held_for_sure():
    """A bit that was held for all but impossible costs its whole surprise: 1 - p of a rounded p would miss some of it."""
    model = small_model(["the cat sat on the mat"])
    model.start[:] = 40  # predictions end at the bounds
    for text in (b"the", b"txq \n", b"qqq"):
        assert len(m.Bits(np.frombuffer(text, np.uint8), np.array([0, len(text)]), model.codes).bit) < m.BLOCK
        assert math.isclose(ln_of(model, text), brute_force(model, list(text)), rel_tol=1e-4, abs_tol=1e-5)


def counted(model, texts):
    total = np.zeros(2 * int(model.offsets[-1]), dtype=np.int32)
    for s in tk.slices(pa.array(texts), lower=True):
        m.count_bits(total, model, m.Stream(s))
    return total


def test_equal_symbols_in_equal_contexts_are_counted_at_once(monkeypatch):
    """A slice is counted by what is distinct in it, not bit by bit; the counts are those of all bits."""
    model = small_model(["the cat sat on the mat"])
    looked_up, slots = [], m.slots
    monkeypatch.setattr(m, "slots", lambda contexts, steps, bits: looked_up.append(len(steps)) or slots(contexts, steps, bits))
    once = counted(model, ["the cat sat " * 2])
    few = sum(looked_up)
    looked_up.clear()
    many = counted(model, ["the cat sat " * 1000])
    assert sum(looked_up) <= few
    n_bits = lambda total: total[: 2 << model.bits[0]].sum()
    assert n_bits(many) > 400 * n_bits(once)
    for t in range(1, m.N_TABLES):
        assert many[2 * model.offsets[t] : 2 * model.offsets[t + 1]].sum() == n_bits(many)


def test_counts_of_long_texts_do_not_depend_on_other_rows(monkeypatch):
    """Contexts begin anew with each segment also where a slice holds more rows than the long one."""
    monkeypatch.setattr(m, "SEGMENT", 100)
    model = small_model(["the cat sat on the mat"])
    texts = ["the cat sat " * 40, "a mat", "x" * 300]
    assert (counted(model, texts) == sum(counted(model, [t]) for t in texts)).all()
