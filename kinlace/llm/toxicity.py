"""Toxic spans by a linear-chain conditional random field.

Labels stand at documents, so tokens are labelled first: a cue is a word, or the beginning of words, that
stands in many different contexts of toxic training documents and hardly in clean ones (copies of a
document bring no new contexts, so they make no cue). A token with a cue in a toxic document is toxic, all
others are clean. On these tokens a two-state chain is trained: hashed features of a word and its
neighbours score the states, and a transition matrix joins them. Forward-backward marginals of every
token then give the document's score (a logistic function of the highest marginal's log-odds and
of the expected number of toxic tokens) and the offending offsets (runs with marginals of at least 1/2).

Training takes a bounded sample of labelled rows, whole texts of at most `max_bytes`: `max_toxic` and
`max_clean` rows of least hash of the id. All documents are scored whole, where they lie.

Defined cases: null, empty and wordless texts score as documents without any toxic token; documents
with two labels count as both; without a toxic training row every score is 0; repeated rows score
alike; an empty table gives no rows; columns other than the id and the text are no inputs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlace.llm import textkit as tk
from kinlace.llm.tables import annotate, crc32_mod, table

_U = np.uint64
_BITS = 18
_PREFIXES = (3, 4, 5, 6)
#: Words of a block; blocks of all documents go through the chain side by side.
BLOCK = 64


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    """Feature number, never 0, which stands for "no feature"."""
    return np.maximum((tk.mix(h + _U(kind * 0x9E3779B97F4A7C15 % 2**64)) >> _U(64 - _BITS)).astype(np.int32), 1)


class Tokens:
    """Words of a slice and their features."""

    def __init__(self, s: tk.Slice) -> None:
        self.starts, self.ends, self.rows = s.words(tk.ALNUM_WORDS)
        self.n_rows = s.n
        self.count = np.bincount(self.rows, minlength=s.n).astype(np.int64)
        self.words = tk.span_hashes(s.data, self.starts, self.ends)
        lens = self.ends - self.starts
        self.begin: dict[int, np.ndarray] = {}
        h = np.zeros(len(lens), dtype=np.uint64)
        data = np.append(s.data, np.zeros(max(_PREFIXES), np.uint8))
        for i in range(max(_PREFIXES)):
            h = (h + data[self.starts + i].astype(np.uint64) + _U(1)) * _U(0xD1B54A32D192ED03)
            if i + 1 in _PREFIXES:
                self.begin[i + 1] = np.where(lens >= i + 1, h, _U(0))

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        before, after = np.zeros_like(self.words), np.zeros_like(self.words)
        same = self.rows[1:] == self.rows[:-1]
        before[1:][same] = self.words[:-1][same]
        after[:-1][same] = self.words[1:][same]
        return before, after

    def cue_keys(self) -> list[np.ndarray]:
        """Keys of which a cue may be one; 0 is none."""
        return [self.words, *(np.where(h == 0, _U(0), tk.mix(h + _U(n))) for n, h in self.begin.items() if n > 3)]

    def features(self) -> list[np.ndarray]:
        before, after = self.neighbours()
        out = [_bucket(self.words, 1)]
        out += [np.where(h == 0, 0, _bucket(h, 10 + n)) for n, h in self.begin.items()]
        return [*out, np.where(before == 0, 0, _bucket(before, 2)), np.where(after == 0, 0, _bucket(after, 3))]


@dataclass
class Model:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << _BITS, dtype=np.float32))
    bias: float = -8.0
    #: Log weights of clean -> toxic, toxic -> clean, toxic -> toxic; clean -> clean is 0.
    moves: np.ndarray = field(default_factory=lambda: np.zeros(3))
    #: Document score: sigmoid of offset + scales . (log-odds of the highest marginal, log of the expected count).
    document: np.ndarray = field(default_factory=lambda: np.zeros(3))
    trained: bool = False

    def emissions(self, features: list[np.ndarray]) -> np.ndarray:
        e = np.full(len(features[0]), self.bias, dtype=np.float64)
        for f in features:
            e += self.weights[f]
        return np.exp(np.clip(e, -25, 25))


class Chain:
    """Forward and backward messages of all rows at once, `BLOCK` words a step."""

    def __init__(self, emission: np.ndarray, count: np.ndarray, moves: np.ndarray) -> None:
        self.t01, self.t10, self.t11 = np.exp(moves)
        blocks = -(-count // BLOCK)
        self.block0 = np.cumsum(blocks) - blocks
        n_blocks = int(blocks.sum())
        first = np.cumsum(count) - count
        place = np.arange(len(emission), dtype=np.int64) - np.repeat(first, count)
        self.at = (place % BLOCK) * n_blocks + np.repeat(self.block0, count) + place // BLOCK
        self.valid = np.zeros((BLOCK, n_blocks), dtype=bool)
        self.valid.ravel()[self.at] = True
        self.e = np.ones((BLOCK, n_blocks))
        self.e.ravel()[self.at] = emission
        self.blocks, self.n_blocks = blocks, n_blocks
        self.log_z = 0.0
        self._messages()

    def _messages(self) -> None:
        n, e, valid = self.n_blocks, self.e, self.valid
        t01, t10, t11 = self.t01, self.t10, self.t11
        p00, p01, p10, p11 = np.ones(n), np.zeros(n), np.zeros(n), np.ones(n)
        for t in range(BLOCK):
            v, x = valid[t], e[t]
            a, b = p00 + p01 * t10, (p00 * t01 + p01 * t11) * x
            c, d = p10 + p11 * t10, (p10 * t01 + p11 * t11) * x
            scale = 1.0 / (a + b + c + d)
            p00, p01 = np.where(v, a * scale, p00), np.where(v, b * scale, p01)
            p10, p11 = np.where(v, c * scale, p10), np.where(v, d * scale, p11)
        # over the blocks of each row; rows by falling number of blocks
        order = np.argsort(-self.blocks, kind="stable")
        have = np.searchsorted(-self.blocks[order], -np.arange(1, (int(self.blocks.max()) if len(self.blocks) else 0) + 1), side="right")
        f0, f1, b0, b1 = np.ones(n), np.zeros(n), np.ones(n), np.ones(n)
        x0, x1 = np.ones(len(order)), np.zeros(len(order))
        for k, m in enumerate(have):
            at = self.block0[order[:m]] + k
            f0[at], f1[at] = x0[:m], x1[:m]
            y0, y1 = x0[:m] * p00[at] + x1[:m] * p10[at], x0[:m] * p01[at] + x1[:m] * p11[at]
            s = 1.0 / (y0 + y1)
            x0[:m], x1[:m] = y0 * s, y1 * s
        x0, x1 = np.ones(len(order)), np.ones(len(order))
        for k in range(len(have) - 1, -1, -1):
            m = have[k]
            at = self.block0[order[:m]] + k
            b0[at], b1[at] = x0[:m], x1[:m]
            y0, y1 = p00[at] * x0[:m] + p01[at] * x1[:m], p10[at] * x0[:m] + p11[at] * x1[:m]
            s = 1.0 / (y0 + y1)
            x0[:m], x1[:m] = y0 * s, y1 * s
        self.in0, self.in1, self.out0, self.out1 = f0, f1, b0, b1

    def marginals(self, pairs: bool = False) -> np.ndarray:
        """P(toxic) of each word; with pairs, also the expected numbers of the three moves (`expected`)."""
        t01, t10, t11 = self.t01, self.t10, self.t11
        fwd = np.empty((BLOCK, self.n_blocks))  # share of the toxic state
        f0, f1 = self.in0.copy(), self.in1.copy()
        prev = np.empty((BLOCK, self.n_blocks)) if pairs else None
        for t in range(BLOCK):
            if pairs:
                prev[t] = f1
            v = self.valid[t]
            y0, y1 = f0 + f1 * t10, (f0 * t01 + f1 * t11) * self.e[t]
            s = 1.0 / (y0 + y1)
            f0, f1 = np.where(v, y0 * s, f0), np.where(v, y1 * s, f1)
            fwd[t] = f1
        out = np.empty((BLOCK, self.n_blocks))
        b0, b1 = self.out0.copy(), self.out1.copy()
        moves = np.zeros(3)
        for t in range(BLOCK - 1, -1, -1):
            v, x = self.valid[t], self.e[t]
            hot, cold = fwd[t] * b1, (1 - fwd[t]) * b0
            out[t] = hot / (hot + cold)
            if pairs:
                q = prev[t]
                w = np.stack([(1 - q) * b0, (1 - q) * t01 * x * b1, q * t10 * b0, q * t11 * x * b1])
                w /= w.sum(axis=0)
                moves += w[1:][:, v].sum(axis=1)
            y0, y1 = b0 + t01 * x * b1, t10 * b0 + t11 * x * b1
            s = 1.0 / (y0 + y1)
            b0, b1 = np.where(v, y0 * s, b0), np.where(v, y1 * s, b1)
        self.expected = moves
        return out.ravel()[self.at]


def find_cues(slices: list[tuple[Tokens, np.ndarray]], min_contexts: int, min_lift: float) -> np.ndarray:
    """Sorted keys of cues, from tokens and each row's label."""
    seen: dict[bool, list[np.ndarray]] = {True: [], False: []}
    for tokens, label in slices:
        before, after = tokens.neighbours()
        context = tk.mix(before * _U(3) + tk.mix(after))
        hot = label[tokens.rows].astype(bool)
        for key in tokens.cue_keys():
            for side in seen:
                live = (key != 0) & (hot == side)
                _, one = np.unique(tk.mix(key[live] ^ tk.mix(context[live])), return_index=True)
                seen[side].append(np.stack([key[live][one], context[live][one]]))
    pairs = {}
    for side, parts in seen.items():
        key, context = np.concatenate(parts, axis=1)
        _, one = np.unique(tk.mix(key ^ tk.mix(context)), return_index=True)
        pairs[side] = key[one]
    hot_keys, n_hot = np.unique(pairs[True], return_counts=True)
    cold_keys, n_cold = np.unique(pairs[False], return_counts=True)
    total_hot, total_cold = max(len(pairs[True]), 1), max(len(pairs[False]), 1)
    some = n_hot >= min_contexts
    hot_keys, n_hot = hot_keys[some], n_hot[some]
    at = np.minimum(np.searchsorted(cold_keys, hot_keys), max(len(cold_keys) - 1, 0))
    cold = np.where(cold_keys[at] == hot_keys, n_cold[at], 0) if len(cold_keys) else np.zeros(len(hot_keys))
    lift = (n_hot / total_hot) / ((cold + 0.5) / total_cold)
    return hot_keys[lift >= min_lift]


def token_labels(tokens: Tokens, label: np.ndarray, cues: np.ndarray) -> np.ndarray:
    if not len(cues):
        return np.zeros(len(tokens.words), dtype=bool)
    hit = np.zeros(len(tokens.words), dtype=bool)
    for key in tokens.cue_keys():
        at = np.minimum(np.searchsorted(cues, key), len(cues) - 1)
        hit |= (cues[at] == key) & (key != 0)
    return hit & label[tokens.rows].astype(bool)


def _document_inputs(marginals: np.ndarray, count: np.ndarray) -> np.ndarray:
    """(1, log-odds of the highest marginal, log of the expected number of toxic words) a row."""
    out = np.zeros((len(count), 3))
    out[:] = (1.0, -12.0, -6.0)
    full = np.flatnonzero(count)
    if len(full):
        first = (np.cumsum(count) - count)[full]
        p = np.clip(marginals, 1e-12, 1 - 1e-9)
        top = np.maximum.reduceat(p, first)
        out[full, 1] = np.clip(np.log(top / (1 - top)), -12, 12)
        out[full, 2] = np.log(np.add.reduceat(np.where(p > 0.01, p, 0.0), first) + np.exp(-6.0))
    return out


def train(texts: pa.Array, labels: np.ndarray, min_contexts: int = 6, min_lift: float = 30.0, epochs: int = 6, rate: float = 0.15, decay: float = 1e-6, seed: int = 7) -> Model:
    """A model from whole texts and their 0/1 labels."""
    model = Model()
    if not len(labels) or not labels.any():
        return model
    parts = [(Tokens(s), labels[s.rows]) for s in tk.slices(texts, lower=True, limit=1 << 19)]
    cues = find_cues(parts, min_contexts, min_lift)
    ready = []
    for tokens, label in parts:
        y = token_labels(tokens, label, cues)
        if len(y):
            ready.append((tokens, label, y, tokens.features()))
    hot = sum(int(y.sum()) for _, _, y, _ in ready)
    total = sum(len(y) for _, _, y, _ in ready)
    model.trained, model.bias = True, float(np.log((hot + 1) / (total + 1)))
    g2 = np.full(1 << _BITS, 1e-8, dtype=np.float64)
    weights = np.zeros(1 << _BITS, dtype=np.float64)
    bias, moves, bias_g2, moves_g2 = model.bias, np.zeros(3), 1e-8, np.full(3, 1e-8)
    rng = np.random.default_rng(seed)
    for _ in range(max(epochs, -(-100 // max(len(ready), 1)))):  # a small sample is gone through more often
        for i in rng.permutation(len(ready)):
            tokens, _, y, features = ready[i]
            model.weights, model.bias, model.moves = weights.astype(np.float32), bias, moves
            chain = Chain(model.emissions(features), tokens.count, moves)
            error = y - chain.marginals(pairs=True)
            scale = 1.0 / np.sqrt(len(y))
            error *= scale
            g = np.zeros(1 << _BITS)
            for f in features:
                g += np.bincount(f, weights=error, minlength=1 << _BITS)
            g[0] = 0
            g -= decay * weights
            g2 += g * g
            weights += rate * g / np.sqrt(g2)
            prev = np.zeros(len(y), dtype=bool)
            prev[1:] = y[:-1] & (tokens.rows[1:] == tokens.rows[:-1])
            seen = np.array([(y & ~prev).sum(), (~y & prev).sum(), (y & prev).sum()], dtype=float)
            gm = (seen - chain.expected) * scale
            moves_g2 += gm * gm
            moves = np.clip(moves + rate * gm / np.sqrt(moves_g2), -8, 8)
            gb = error.sum()
            bias_g2 += gb * gb
            bias += rate * gb / np.sqrt(bias_g2)
    model.weights, model.bias, model.moves = weights.astype(np.float32), float(bias), moves
    # the document's function, by Newton steps on the training documents
    x = np.concatenate([_document_inputs(Chain(model.emissions(f), t.count, moves).marginals(), t.count) for t, _, _, f in ready])
    y = np.concatenate([label for _, label, _, _ in ready]).astype(float)
    w, ridge = np.zeros(3), np.diag([1e-3, 1e-2, 1e-2]) * len(y)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(3), x.T @ (y - p) - ridge @ w)
    model.document = w
    return model


def score_texts(texts: pa.Array, model: Model, spans: bool = True) -> tuple[np.ndarray, np.ndarray, list[list[dict]]]:
    """Scores, expected numbers of toxic words, and spans (start, end in code points, p: highest marginal)."""
    scores, expected, found = [], [], []
    for s in tk.slices(texts, lower=True):
        tokens = Tokens(s)
        if not model.trained:
            p = np.zeros(len(tokens.words))
        else:
            p = Chain(model.emissions(tokens.features()), tokens.count, model.moves).marginals()
        x = _document_inputs(p, tokens.count)
        scores.append(1 / (1 + np.exp(-np.clip(x @ model.document, -30, 30))) if model.trained else np.zeros(s.n))
        expected.append(np.bincount(tokens.rows, weights=p, minlength=s.n))
        lists: list[list[dict]] = [[] for _ in range(s.n)]
        hot = np.flatnonzero(p >= 0.5) if spans else []
        if len(hot):
            point = np.cumsum((s.data & 0xC0) != 0x80)  # code points up to and with each byte
            base = np.concatenate([[0], point])[s.off]
            joined = np.concatenate([[False], (np.diff(hot) == 1) & (np.diff(tokens.rows[hot]) == 0)])
            opens = np.flatnonzero(~joined)
            for a, b in zip(opens, np.append(opens[1:], len(hot)), strict=True):
                i, j = hot[a], hot[b - 1]
                row = tokens.rows[i]
                lists[row].append({"start": int(point[tokens.starts[i]] - 1 - base[row]), "end": int(point[tokens.ends[j] - 1] - base[row]), "p": float(p[i : j + 1].max())})
        found += lists
    return np.concatenate(scores or [np.zeros(0)]), np.concatenate(expected or [np.zeros(0)]), found


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_toxic: int = 1_500, max_clean: int = 3_000, max_bytes: int = 20_000) -> Model:
    """Train on the labelled rows of least hash of the id, at most so many of each label, of texts of at most max_bytes."""
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).filter("__y IN (0, 1) AND __id IS NOT NULL").distinct()
    pick = lambda y, n: known.filter(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(n)
    chosen = F.broadcast(pick(1, max_toxic).unionByName(pick(0, max_clean)))  # at most max_toxic + max_clean ids
    docs = documents.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text")).filter(F.octet_length("text") <= max_bytes)
    got = docs.join(chosen, "__id").groupBy("__id", "__y").agg(F.min("text").alias("text")).orderBy(F.xxhash64("__id"), "__y").select("text", "__y").toArrow()
    return train(got.column("text").combine_chunks(), np.array(got.column("__y").to_pylist(), dtype=np.int64))


def score_documents(documents: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of documents, toxic_score, toxic_words (expected number) and toxic_spans."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # 2**18 weights, whatever the input

    def work(texts: pa.Array) -> list[pa.Array]:
        score, expected, spans = score_texts(texts, shared.value)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
        return [pa.array(score, pa.float64()), pa.array(expected, pa.float64()), pa.array(spans, kind)]

    return annotate(documents, text_col, work, "toxic_score double, toxic_words double, toxic_spans array<struct<start:int,end:int,p:double>>")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = fit(documents, labels.filter(crc32_mod("doc_id", 3) != 1))
    scored = score_documents(documents, model)
    return scored.select(
        "doc_id",
        (crc32_mod("doc_id", 3) == 1).alias("held_out"),
        F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= 0.7).cast("int").alias("predicted"),
        F.col("toxic_words"),
        F.size("toxic_spans").cast("long").alias("n_spans"),
        F.to_json("toxic_spans").alias("spans"),
    )
