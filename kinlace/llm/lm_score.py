"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is the stream of its lower-case words, each closed by a blank, and one end symbol. A symbol is coded
as the path of bits through a Huffman tree of the symbol before it, or of the two before if they are frequent. For each bit, predictors look up what
followed in training: the bits so far with the tree, with the last 4 and with the last 6 symbols, which cross the borders of words, and
with the word so far and the word before. Each has a table of counted zeros and ones by hash; a pair of counts
is a log-odds. One more predictor expects what followed the word so far the last time in this document. A
gate (how long such a run is, and how well the last 6 symbols and the two words are known) chooses the weights
that mix all log-odds to a probability. The weights start at fixed ones and are refined along each document:
after each block of bits, by the block's gradient over the curvature so far. Blocks grow with the place in
the document, so a document of any length takes few steps, and what a bit costs depends only on training and
on bits before its block: the total is the log-probability of a proper sequential code.

All training documents are counted, in tables of at most `TABLE_BITS`, which grow with the corpus up to
there; these, the trees and the `HOT_WORDS` most frequent words are what is broadcast. The base score's counts
of all other words reach the documents by a join.

Base score: sum over tokens of log10((c + 1) / (N + V + 1)), where c is the token's training count.

Defined cases: a null or empty text is the end symbol alone; without training documents counts are 0
and N = V = 0; repeated rows score alike (each row has its own result); an empty table gives no rows; other
columns are ignored. Words are compared by 64-bit hashes. Of a text beyond `SEGMENT` symbols, contexts begin
anew with each segment, while weights go on.
"""

from __future__ import annotations

import heapq
import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlace.llm import textkit as tk
from kinlace.llm.tables import crc32_mod, saved, scratch, table

_U = np.uint64
#: Symbols that no word has: the end of a word, and of the text.
BLANK, END = 0x20, 0x0A
#: Symbols before a symbol that are contexts of two predictors.
ORDERS = (4, 6)
#: log2 of the tables' slots at most: the tree, the last 4 symbols, the last 6, the word so far with the word before.
TABLE_BITS = (18, 22, 22, 22)
N_TABLES = len(TABLE_BITS)
N_INPUTS = N_TABLES + 1
CHUNK = 1 << 16
HOT_WORDS = 1 << 20
GATES = 24
SEGMENT = 1 << 17
#: Trees: one for each symbol before, and more for pairs of symbols before that are frequent.
TREES = 1024
#: Weights at a document's start, the share of a full step, and the curvature that is there at the start.
START = (0.15, 0.40, 0.45, 0.40, 0.40)
RATE, CURVATURE = 2.0, 24.0
#: Bits of a document's first blocks; later ones are a share of the bits before them.
BLOCK, GROWTH = 64, 32
#: Training text that a task counts, if tasks are few.
COUNT_BYTES = 48 << 20
#: Text whose symbols are counted at once, and symbols whose predictors are looked up at once.
COUNT_SLICE, NEAR = 2 << 20, 1 << 15
#: Least counts of the 16 levels that a count is kept as, and what a level counts as.
_LEVELS = np.array([0, 1, 2, 3, 4, 5, 6, 8, 12, 20, 40, 100, 400, 2_000, 20_000, 200_000])
_MIDDLE = np.array([0, 1, 2, 3, 4, 5, 6.9, 9.5, 15, 28, 63, 200, 900, 6_300, 63_000, 500_000])
#: Log-odds of each state (level of zeros, level of ones), and how much a state has seen: nothing, little, more, much.
_ODDS = np.log((np.tile(_MIDDLE, 16) + 0.4) / (np.repeat(_MIDDLE, 16) + 0.4)).astype(np.float32)
_SEEN = np.digitize(np.repeat(_MIDDLE, 16) + np.tile(_MIDDLE, 16), [0.5, 2.5, 15]).astype(np.uint8)
_RUN_ODDS = np.log((np.arange(16) + 0.4) / 0.4).astype(np.float32)
#: Bits of a number that holds a tree and a symbol, and of one that holds a bit's place among those coded side by side.
_PAIR, _PLACE = (TREES << 8).bit_length() - 1, 25
_C1, _C2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


# --- words ------------------------------------------------------------------------------------------------


END_HASH = tk.span_hashes(np.array([END], dtype=np.uint8), np.array([0]), np.array([1]))[0]


class Stream:
    """A slice's symbols, and where its rows begin in them."""

    def __init__(self, s: tk.Slice) -> None:
        starts, ends, rows = self.spans = s.words(tk.SPACE_WORDS)
        size = ends - starts
        self.stream_off = np.concatenate([[0], np.cumsum(np.bincount(rows, weights=size + 1, minlength=s.n).astype(np.int64) + 1)])
        self.symbols = np.full(int(self.stream_off[-1]), BLANK, dtype=np.uint8)
        self.symbols[self.stream_off[1:] - 1] = END
        self.symbols[tk.ranges(np.cumsum(size + 1) - size - 1 + rows, size)] = s.data[tk.ranges(starts, size)]


class Words(Stream):
    """Also its tokens: each word, and an end for each row, by number among the slice's distinct words (0: end)."""

    def __init__(self, s: tk.Slice) -> None:
        super().__init__(s)
        starts, ends, rows = self.spans
        hashes = tk.span_hashes(s.data, starts, ends)
        order = np.argsort(hashes)  # equal hashes are one word, so any of a word's places will do
        hashes = hashes[order]
        fresh = np.ones(len(hashes), dtype=bool)
        fresh[1:] = hashes[1:] != hashes[:-1]
        first, hashes = order[fresh], hashes[fresh]
        which = np.empty(len(order), dtype=np.int64)
        which[order] = np.cumsum(fresh)
        self.hashes = np.concatenate([[END_HASH], hashes])
        self.starts, self.ends, self.data = starts[first], ends[first], s.data
        self.n_words = np.bincount(rows, minlength=s.n).astype(np.int64)
        self.off = np.concatenate([[0], np.cumsum(self.n_words + 1)])
        self.tokens = np.zeros(int(self.off[-1]), dtype=np.int64)
        inner = np.ones(len(self.tokens), dtype=bool)
        inner[self.off[1:] - 1] = False
        self.tokens[inner] = which
        self.rows = np.repeat(np.arange(s.n), self.n_words + 1)


def symbol_counts(words: list[bytes], counts: np.ndarray, trees: np.ndarray | None = None) -> np.ndarray:
    """[tree << 8 | symbol]: how often, in words as the vocabulary has them and as often as counted. Without trees: [symbol before << 8 | symbol]."""
    units = [w if w == bytes([END]) else w + bytes([BLANK]) for w in words]
    symbols = np.frombuffer(bytes([BLANK]) + bytes([BLANK]).join(units), dtype=np.uint8)  # each word's first follows a blank
    size = np.array([len(u) for u in units], dtype=np.int64)
    last = np.cumsum(size + 1)
    often = np.repeat(counts, size)
    inner = np.ones(len(symbols), dtype=bool)
    inner[0] = False
    inner[last[:-1]] = False
    at = np.flatnonzero(inner)
    before = symbols[at - 1].astype(np.int64)
    if trees is not None:
        before = trees[symbols[at - 2].astype(np.int64) << 8 | before].astype(np.int64)  # what is before a blank doesn't matter
    return np.bincount(before << 8 | symbols[at], weights=often, minlength=65_536 if trees is None else TREES << 8)


def frequent_trees(pairs: np.ndarray) -> np.ndarray:
    """[symbol two before << 8 | symbol before]: the tree; one of its own for pairs that make up a 4096th of all, and that are no
    word's end. pairs: [symbol before << 8 | symbol], counted."""
    out = np.tile(np.arange(256, dtype=np.uint16), 256)
    often = pairs.copy()
    often[np.isin(np.arange(65_536) & 0xFF, (BLANK, END))] = 0
    best = np.argsort(-often, kind="stable")[: TREES - 256]
    best = best[often[best] * 4096 >= max(pairs.sum(), 1)]
    out[best] = 256 + np.arange(len(best), dtype=np.uint16)
    return out


# --- bits -------------------------------------------------------------------------------------------------


class Codes:
    """A Huffman tree over all 256 symbols for each tree that `trees` has."""

    def __init__(self, counts: np.ndarray, trees: np.ndarray) -> None:
        """counts: [tree, symbol]. They are scaled, so that no path is longer than 40 bits."""
        self.trees = trees
        n = int(trees.max()) + 1
        lens, nodes, bits = np.zeros(n << 8, dtype=np.int64), [], []
        self.path = np.zeros(n << 8, dtype=np.uint64)  # from the highest bit on
        for p in range(n):
            scale = max(1, int(counts[p].sum()) >> 20)
            heap = [(int(c) // scale + 1, i, i) for i, c in enumerate(counts[p])]
            heapq.heapify(heap)
            parent: dict[int, tuple[int, int]] = {}
            fresh = 256
            while len(heap) > 1:
                a, b = heapq.heappop(heap), heapq.heappop(heap)
                parent[a[2]], parent[b[2]] = (fresh, 0), (fresh, 1)
                heapq.heappush(heap, (a[0] + b[0], fresh, fresh))
                fresh += 1
            for s in range(256):
                path, x = [], s
                while x in parent:
                    x, bit = parent[x]
                    path.append((p << 8 | (x - 256), bit))
                lens[p << 8 | s] = len(path)
                word = 0
                for d, (node, bit) in enumerate(reversed(path)):
                    nodes.append(node)
                    bits.append(bit)
                    word |= bit << (63 - d)
                self.path[p << 8 | s] = word
        self.len = lens.astype(np.int32)
        self.off = (np.cumsum(lens) - lens).astype(np.int32)
        #: Of each bit of each path: its node and value (node << 1 | bit), and its place in the path.
        self.step = np.array(nodes, dtype=np.int32) << 1 | np.array(bits, dtype=np.int32)
        self.depth = (np.arange(len(nodes)) - np.repeat(self.off, lens)).astype(np.int8)

    def pairs(self, symbols: np.ndarray, off: np.ndarray) -> np.ndarray:
        """tree << 8 | symbol of each symbol of some rows; blanks stand before a row."""
        before = np.full(len(symbols) + 2, BLANK, dtype=np.uint16)
        before[2:] = symbols
        context = before[:-2] << np.uint16(8) | before[1:-1]
        context[off[:-1]] = BLANK << 8 | BLANK
        second = off[:-1][np.diff(off) > 1]
        context[second + 1] = BLANK << 8 | symbols[second].astype(np.uint16)
        return self.trees[context].astype(np.int32) << 8 | symbols


def last_followers(contexts: np.ndarray, symbols: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of at most SEGMENT symbols: what followed its context the last time in its row, and for how many times on
    end (0: never before). Contexts are compared by 43 bits, beside which the place fits in a word, so that words sort alone."""
    bits = _U(21)
    at = np.arange(len(symbols), dtype=np.uint64)
    key = contexts + (rows.astype(np.uint64) + _U(1)) * tk._STEP  # differ between rows
    _mix(key)
    key &= ~((_U(1) << bits) - _U(1))
    key |= at
    key.sort()
    order = (key & ((_U(1) << bits) - _U(1))).astype(np.int32)
    k, s = key >> bits, symbols[order]
    fresh = np.concatenate([[True], k[1:] != k[:-1]])
    turn = fresh | np.concatenate([[True], s[1:] != s[:-1]])
    at = np.arange(len(order), dtype=np.int32)
    length = np.minimum(at - np.maximum.accumulate(np.where(turn, at, 0)) + 1, 15)
    expected, often = np.zeros(len(order), dtype=np.uint8), np.zeros(len(order), dtype=np.uint8)
    again = np.flatnonzero(~fresh)
    expected[order[again]], often[order[again]] = s[again - 1], length[again - 1]
    return expected, often


def block_cuts(n_bits: int) -> np.ndarray:
    """Where blocks of a document begin, up to n_bits: a rule of the place alone."""
    cuts = [0]
    while cuts[-1] < n_bits:
        cuts.append(cuts[-1] + max(BLOCK, cuts[-1] // GROWTH))
    return np.array(cuts, dtype=np.int64)


class Contexts:
    """What the predictors of some rows' symbols look at, by symbol."""

    def __init__(self, symbols: np.ndarray, off: np.ndarray, codes: Codes) -> None:
        n = len(symbols)
        self.symbols, self.off, self.codes = symbols, off, codes
        self.pair = codes.pairs(symbols, off)
        wide = symbols.astype(np.uint64)
        wide += _U(1)
        self.contexts = []
        most = max(ORDERS)
        # a row's first symbols have zeros before them: they stand behind the others once more, each row's with its zeros
        lens = np.minimum(np.diff(off), most)
        head = tk.ranges(off[:-1], lens)
        beside = n + tk.ranges(np.arange(1, len(off), dtype=np.int64) * 2 * most - most, lens)
        padded = np.zeros(n + 2 * most * (len(off) - 1), dtype=np.uint64)
        padded[:n] = wide
        padded[beside] = wide[head]
        h = np.zeros(len(padded), dtype=np.uint64)
        for k in range(1, most + 1):
            h *= _U(0x100000001B3)
            h[k:] += padded[:-k]
            if k in ORDERS:
                mixed = h + _U(k)
                mixed[head] = mixed[beside]
                self.contexts.append(_high(mixed[:n]))
        del padded, h, mixed
        # the word so far; a word begins behind a blank
        begins = np.zeros(n, dtype=bool)
        begins[1:] = symbols[:-1] == BLANK
        begins[off[:-1]] = True
        first = np.flatnonzero(begins)
        size = np.diff(np.append(first, n))
        inside = np.arange(n) - np.repeat(first, size)
        wide *= tk._POWERS.upto(int(inside.max(initial=0))).take(inside, mode="clip")
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(wide, out=sums[1:])
        self.word = inside.view(np.uint64)
        self.word *= _U(0x9E3779B97F4A7C15)
        self.word += sums[:-1]
        self.word -= np.repeat(sums[first], size)
        _mix(self.word)
        before = np.zeros(len(first), dtype=np.uint64)  # the word before each: the context of its blank
        before[1:] = self.word[first[1:] - 1]
        before[np.searchsorted(first, off[:-1])] = 0
        pair = np.repeat(before * _U(0xD6E8FEB86659FD93), size)
        pair += _U(3)
        pair ^= self.word
        self.contexts.append(_high(pair))


def _mix(h: np.ndarray) -> np.ndarray:
    """tk.mix in place."""
    high = h >> _U(32)
    for _ in range(2):
        h ^= high
        h *= _U(0xD6E8FEB86659FD93)
        np.right_shift(h, _U(32), out=high)
    h ^= high
    return h


def _high(h: np.ndarray) -> np.ndarray:
    """The high halves of tk.mix, which takes the place of h."""
    return _mix(h).view(np.uint32)[1 if sys.byteorder == "little" else 0 :: 2].copy()


def slots(contexts: np.ndarray, steps: np.ndarray, bits: int) -> np.ndarray:
    """Slots, in a table of 2**bits, of steps with contexts; takes the place of contexts."""
    node = (steps >> 1).view(np.uint32)
    node *= _C1
    contexts ^= node
    contexts *= _C2
    contexts >>= np.uint32(32 - bits)
    return contexts.view(np.int32)


class Bits(Contexts):
    """Also all bits of these symbols, one after the other."""

    def __init__(self, symbols: np.ndarray, off: np.ndarray, codes: Codes) -> None:
        super().__init__(symbols, off, codes)
        lens = codes.len[self.pair]
        total = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])
        self.n_bits = np.diff(total[off])  # of rows
        self.symbol = np.repeat(np.arange(len(symbols)), lens)
        self.at = (codes.off[self.pair] - total[:-1]).take(self.symbol, mode="clip")
        self.at += np.arange(int(total[-1]))
        self.step = codes.step.take(self.at, mode="clip")
        self.bit = (self.step & 1).astype(bool)

    def slots(self, t: int, bits: int) -> np.ndarray:
        """Slot in table t of 2**bits slots."""
        return slots(self.contexts[t - 1].take(self.symbol, mode="clip"), self.step, bits) if t else self.step >> 1

    def run_input(self) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of each bit's own value by the predictor that looks at the document, and how sure it is: 0, 1, 2."""
        expected, often = last_followers(self.word, self.symbols, np.repeat(np.arange(len(self.off) - 1), np.diff(self.off)))
        # bits up to the first that differs
        alike = np.full(len(often), 100, dtype=np.int8)
        apart = np.flatnonzero(expected != self.symbols)
        own = self.pair[apart]
        path = self.codes.path
        differ = (path[own] ^ path[own & ~0xFF | expected[apart]]).astype(np.float64)
        # the exponent of a float is its highest bit
        alike[apart] = np.int64(1086) - (np.maximum(differ, 1).view(np.int64) >> 52)
        alike[often == 0] = -1
        ahead = alike.take(self.symbol, mode="clip")
        ahead -= self.codes.depth.take(self.at, mode="clip")
        side = (ahead >= 0).view(np.int8)
        run = np.minimum(often, 2).take(self.symbol, mode="clip")
        run *= side.view(np.uint8)
        side -= (ahead == 0).view(np.int8) << np.int8(1)
        x = _RUN_ODDS.take(often).take(self.symbol, mode="clip")
        x *= side
        return x, run


def states(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """A byte for each pair of counts."""
    level = lambda n: np.searchsorted(_LEVELS, n, side="right") - 1
    return (level(n0) << 4 | level(n1)).astype(np.uint8)


def table_bits(n_bytes: int) -> tuple[int, ...]:
    """log2 of the tables' slots for a corpus of so many bytes."""
    return tuple(b if t == 0 else min(b, max(16, int(n_bytes).bit_length() - 3)) for t, b in enumerate(TABLE_BITS))


@dataclass
class Model:
    codes: Codes
    bits: tuple[int, ...] = TABLE_BITS
    tables: np.ndarray | None = None
    start: np.ndarray = field(default_factory=lambda: np.array(START, dtype=np.float32))

    def __post_init__(self) -> None:
        self.offsets = np.concatenate([[0], np.cumsum([1 << b for b in self.bits])])
        if self.tables is None:
            self.tables = np.zeros(int(self.offsets[-1]), dtype=np.uint8)

    def inputs(self, bits: Bits) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of each bit's own value by all predictors [input, bit], and gates."""
        x = np.empty((N_INPUTS, len(bits.symbol)), dtype=np.float32)
        for t, b in enumerate(self.bits):
            state = self.tables[self.offsets[t] : self.offsets[t + 1]].take(bits.slots(t, b), mode="clip")
            np.take(_ODDS, state, out=x[t], mode="clip")
            if t == N_TABLES - 2:
                longer = _SEEN.take(state, mode="clip")
        x[:N_TABLES].view(np.uint32)[:] ^= (~bits.step).view(np.uint32) << np.uint32(31)  # the sign, of zeros
        x[N_TABLES], gate = bits.run_input()
        gate *= np.uint8(4)
        gate += longer
        gate *= np.uint8(2)
        gate += (_SEEN > 0).view(np.uint8).take(state, mode="clip")
        return x, gate


class Weights:
    """The weights of some rows, which go on from part to part."""

    def __init__(self, model: Model, n: int) -> None:
        self.w = np.repeat(model.start[:, None], n * GATES, axis=1)
        self.curvature = np.full(n * GATES, float(CURVATURE))
        self.bits = 0


#: Rows that are coded side by side at most; their weights are held at once.
PART_ROWS = 4096


def code_cost(model: Model, symbols: np.ndarray, off: np.ndarray, weights: Weights | None = None) -> np.ndarray:
    """Natural log of each row's probability. weights: of the one row, whose earlier symbols were coded before."""
    n = len(off) - 1
    weights = weights or Weights(model, n)
    parts, n_bits, at = [], [], 0
    while at < n:  # a few rows at a time, so that what is worked on stays near the core
        to = max(at + 1, int(np.searchsorted(off, off[at] + NEAR, side="right")) - 1)
        bits = Bits(symbols[off[at] : off[to]], off[at : to + 1] - off[at], model.codes)
        parts.append(model.inputs(bits))
        n_bits.append(bits.n_bits)
        at = to
    x = [np.concatenate([part[0][k] for part in parts]) for k in range(N_INPUTS)]
    gate, n_bits = np.concatenate([part[1] for part in parts]), np.concatenate(n_bits)
    del parts, bits
    # in the order of the steps: blocks, and rows in a block, and gates of a row, so that what is added up stands together
    begun = weights.bits
    cuts = block_cuts(int(n_bits.max(initial=0)) + begun)
    block = np.repeat(np.arange(len(cuts) - 1, dtype=np.uint64) * _U(n << 5 << _PLACE), np.diff(cuts))
    key = np.concatenate([block[begun : begun + k] for k in n_bits.tolist()])
    key += np.repeat(np.arange(n, dtype=np.uint64) << _U(5 + _PLACE), n_bits)
    key += gate.astype(np.uint64) << _U(_PLACE)
    key += np.arange(len(key), dtype=np.uint64)
    key.sort()
    order = (key & _U((1 << _PLACE) - 1)).view(np.int64)
    key >>= _U(_PLACE)
    first = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])  # of each run: a row's bits with a gate in a block
    lens = np.diff(first, append=len(key))
    run = key[first].view(np.int64)
    block, row = np.divmod(run >> 5, n)
    cell = row * GATES + (run & 31)
    xs = np.empty((N_INPUTS + 1, len(key)), dtype=np.float32)
    for k in range(N_INPUTS):
        np.take(x[k], order, out=xs[k], mode="clip")
    xs[N_INPUTS] = np.einsum("kn,kn->n", xs[:N_INPUTS], xs[:N_INPUTS])
    inverse = np.empty(len(key), dtype=np.float32)  # 1 / probability
    ends = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(run)]])
    places = np.append(first, len(key))[ends]
    for r, q, a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), places[:-1].tolist(), places[1:].tolist(), strict=True):
        mine, c = xs[:, a:b], cell[r:q]
        w = weights.w.take(c, axis=1)
        wx = np.repeat(w, lens[r:q], axis=1)
        wx *= mine[:N_INPUTS]
        z = np.add.reduce(wx, axis=0)
        np.negative(z, out=z)
        np.maximum(z, -16, out=z)
        np.minimum(z, 16, out=z)
        np.exp(z, out=z)
        inv = np.add(z, 1, out=inverse[a:b])
        miss = np.divide(z, inv, out=z)
        mine *= miss  # slopes
        mine[N_INPUTS] *= 1 - miss
        sums = np.add.reduceat(mine, first[r:q] - a, axis=1)
        curvature = weights.curvature[c] + sums[N_INPUTS]
        weights.curvature[c] = curvature
        weights.w[:, c] = w + RATE * sums[:N_INPUTS] / curvature
    weights.bits += int(n_bits[0])
    np.log(inverse, out=inverse)
    return -np.bincount(row, weights=np.add.reduceat(inverse, first, dtype=np.float64), minlength=n)


def text_costs(model: Model, w: Words) -> np.ndarray:
    """Natural log of the probability of each row of a slice."""
    out, off, n = np.zeros(len(w.n_words)), w.stream_off, len(w.n_words)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + SEGMENT, side="right")) - 1)
        to = min(to, at + PART_ROWS)
        if off[to] - off[at] <= SEGMENT:
            out[at:to] = code_cost(model, w.symbols[off[at] : off[to]], off[at : to + 1] - off[at])
        else:
            weights = Weights(model, 1)
            for a in range(int(off[at]), int(off[to]), SEGMENT):
                part = w.symbols[a : min(a + SEGMENT, int(off[to]))]
                out[at] += code_cost(model, part, np.array([0, len(part)]), weights)[0]
        at = to
    return out


# --- over tables ------------------------------------------------------------------------------------------


def vocabulary(texts: DataFrame) -> DataFrame:
    """h (hash), word (binary), c (count) of all tokens of a frame with one text column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in tk.slices(batch.column(0), lower=True, limit=4 << 20):
                w = Words(s)
                count = np.bincount(w.tokens, minlength=len(w.hashes))
                raw = w.data.tobytes()
                words = [bytes([END]), *(raw[a:b] for a, b in zip(w.starts.tolist(), w.ends.tolist(), strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(w.hashes.view(np.int64)), pa.array(words, pa.binary()), pa.array(count, pa.int64())], names=["h", "word", "c"])
        tk.release()

    return texts.mapInArrow(run, "h long, word binary, c long").groupBy("h", "word").agg(F.sum("c").alias("c"))


def _symbol_counts(vocab: DataFrame, trees: np.ndarray | None = None) -> np.ndarray:
    """symbol_counts of a vocabulary."""
    size = 65_536 if trees is None else TREES << 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += symbol_counts(batch.column(0).to_pylist(), batch.column(1).to_numpy(), trees)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at].astype(np.int64), pa.int64())], names=["pair", "c"])

    got = vocab.select("word", "c").mapInArrow(run, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")).toArrow()  # `size` rows at most
    out = np.zeros(size, dtype=np.int64)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out


def count_bits(total: np.ndarray, model: Model, w: Stream) -> None:
    """Add a slice's bits to total: zeros and ones of each slot of the model's tables, side by side."""
    off, codes = w.stream_off, model.codes
    if np.diff(off).max(initial=0) > SEGMENT:  # a long text's segments are rows of their own
        off = np.concatenate([*(np.arange(a, b, SEGMENT) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)), off[-1:]])
    x = Contexts(w.symbols, off, codes)

    def add(t: int, contexts: np.ndarray | None, pair: np.ndarray, often: np.ndarray) -> None:
        """Of symbols that occur so often with their contexts, all bits."""
        lens = codes.len[pair]
        step = codes.step.take(tk.ranges(codes.off[pair].astype(np.int64), lens), mode="clip")
        key = (step >> 1 if contexts is None else slots(np.repeat(contexts, lens), step, model.bits[t])).astype(np.uint64)
        # sorted: slots are met at random, and each is then added to once
        key <<= _U(1)
        key |= (step & 1).view(np.uint32)
        key <<= _U(32)
        key |= np.repeat(often.astype(np.uint32), lens)
        key.sort()
        parts = key.view(np.uint32).reshape(-1, 2)
        often, slot = (parts if sys.byteorder == "little" else parts[:, ::-1]).T
        first = np.concatenate([[0], np.flatnonzero(slot[1:] != slot[:-1]) + 1])
        total[2 * int(model.offsets[t]) : 2 * int(model.offsets[t + 1])][slot[first]] += np.add.reduceat(often.view(np.int32), first, dtype=np.int32)

    often = np.bincount(x.pair)
    pair = np.flatnonzero(often)
    add(0, None, pair, often[pair])
    for t, contexts in enumerate(x.contexts, 1):
        # equal symbols in equal contexts have the same bits: each is gone through once
        key = contexts.astype(np.uint64)
        key <<= _U(_PAIR)
        key |= x.pair.view(np.uint32)
        key.sort()
        first = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
        often, key = np.diff(first, append=len(key)), key[first]
        add(t, (key >> _U(_PAIR)).astype(np.uint32), (key & _U((1 << _PAIR) - 1)).astype(np.int32), often)


def _count_tables(texts: DataFrame, model: Model) -> DataFrame:
    """chunk, counts: packed zeros and ones of each chunk of table slots, from each task."""
    import zstandard

    shared = texts.sparkSession.sparkContext.broadcast((model.codes, model.bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Model(*shared.value)
        total = np.zeros(2 * int(mine.offsets[-1]), dtype=np.int32)
        tk.keep()
        for batch in batches:
            for s in tk.slices(batch.column(0), lower=True, limit=COUNT_SLICE):
                count_bits(total, mine, Stream(s))
        pack = zstandard.ZstdCompressor(level=1).compress
        for chunk, part in enumerate(total.reshape(-1, 2 * CHUNK)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([pack(part.tobytes())], pa.binary())], names=["chunk", "counts"])
        tk.release()

    return texts.mapInArrow(run, "chunk long, counts binary")


def _add_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            n = np.frombuffer(unpack(blob), dtype=np.int32).astype(np.int64)
            total[chunk] = total[chunk] + n if chunk in total else n
    made = [states(n[::2], n[1::2]).tobytes() for n in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(made, pa.binary())], names=["chunk", "states"])


def hot_words(vocab: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of all words at least so frequent that they are at most `most`."""
    by_count = vocab.groupBy(F.least("c", F.lit(100_000)).alias("c")).agg(F.count("*").alias("n")).collect()  # 100,000 rows at most
    least, n = None, 0
    for r in sorted(by_count, key=lambda r: -r["c"]):
        n += r["n"]
        if n > most:
            break
        least = r["c"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    got = vocab.filter(F.col("c") >= least).select("h", "c").toArrow()
    h, c = got.column(0).to_numpy().view(np.uint64), got.column(1).to_numpy()
    order = np.argsort(h)
    return h[order], c[order]


def train(vocab: DataFrame, texts: DataFrame, n_bytes: int) -> Model:
    """vocab: a written table of vocabulary(); texts: the training texts, n_bytes of them."""
    spark = vocab.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    trees = frequent_trees(_symbol_counts(vocab))
    model = Model(Codes(_symbol_counts(vocab, trees).reshape(TREES, 256), trees), table_bits(n_bytes))
    # each task sends tables of its own, so tasks are few: by size, and a few for each core of a large corpus
    tasks = min(math.ceil(n_bytes / COUNT_BYTES), 4 * spark.sparkContext.defaultParallelism)
    added = _count_tables(texts.coalesce(max(tasks, 1)), model).repartition(n, "chunk").mapInArrow(_add_tables, "chunk long, states binary")
    for r in added.toLocalIterator():  # a byte for each slot of tables of bounded size
        model.tables[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.states, dtype=np.uint8)
    return model


class Scorer:
    """A model and the most frequent words' counts."""

    def __init__(self, model: Model, hot: np.ndarray, hot_counts: np.ndarray) -> None:
        self.model, self.hot, self.hot_counts = model, hot, hot_counts

    def score(self, s: tk.Slice, n: int, v: int) -> dict[str, np.ndarray | list]:
        w = Words(s)
        out: dict[str, np.ndarray | list] = {"n_tokens": w.n_words + 1, "n_bytes": np.diff(w.stream_off)}
        out["ln"] = text_costs(self.model, w)
        at = np.minimum(np.searchsorted(self.hot, w.hashes), max(len(self.hot) - 1, 0))
        is_hot = self.hot[at] == w.hashes if len(self.hot) else np.zeros(len(w.hashes), dtype=bool)
        count = np.where(is_hot, self.hot_counts[at], 0) if len(self.hot) else np.zeros(len(w.hashes))
        logs = np.log10((count + 1) / (n + v + 1))
        hot = is_hot[w.tokens]
        out["hot_score"] = np.bincount(w.rows, weights=np.where(hot, logs[w.tokens], 0.0), minlength=s.n)
        out["hot_known"] = np.bincount(w.rows, weights=hot, minlength=s.n).astype(np.int64)
        # all other words go on as distinct words of each row
        cold = np.flatnonzero(~hot)
        key, times = np.unique(w.rows[cold] * len(w.hashes) + w.tokens[cold], return_counts=True)
        rows, word = key // len(w.hashes), key % len(w.hashes)
        cuts = np.searchsorted(rows, np.arange(s.n + 1))
        out["cold"], out["times"], out["cuts"] = w.hashes[word].view(np.int64), times, cuts
        return out


SCORED = "row long, n_tokens long, n_bytes long, ln double, hot_score double, hot_known long, cold array<long>, times array<long>"


def score_documents(documents: DataFrame, is_training: Column, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT_WORDS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score (both log10), bits_per_byte for each row.

    Learns from the rows where is_training (a column of documents) is true."""
    spark = documents.sparkSession
    folder = scratch(spark, "lm")
    texts = documents.filter(is_training).select(F.col(text_col).cast("string").alias("text"))
    vocab = saved(vocabulary(texts), f"{folder}/vocabulary")
    sums = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.col("c") * (F.octet_length("word") + 1)), F.lit(0)).alias("b")).first()
    n, v = int(sums["n"]), int(sums["v"])
    model = train(vocab, texts, int(sums["b"]))
    shared = spark.sparkContext.broadcast(Scorer(model, *hot_words(vocab, hot)))  # 2**20 words and the tables, whatever the input
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value
        tk.keep()
        for batch in batches:
            for s in tk.slices(batch.column(1), lower=True, limit=SEGMENT):
                x = scorer.score(s, n, v)
                lists = lambda name: pa.ListArray.from_arrays(pa.array(x["cuts"], pa.int32()), pa.array(x[name], pa.int64()))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(s.rows.start, s.n),
                        batch.column(2).slice(s.rows.start, s.n),
                        *(pa.array(x[c]) for c in ("n_tokens", "n_bytes", "ln", "hot_score", "hot_known")),
                        lists("cold"),
                        lists("times"),
                    ],
                    names=["id", *(f.split(" ")[0] for f in SCORED.split(", "))],
                )
        tk.release()

    scored = saved(docs.mapInArrow(run, f"id {id_type}, {SCORED}"), f"{folder}/scored")
    # the rest of the words meet their counts; a word's counts are one row, so Spark can split a hot word's documents
    cold = scored.select("row", F.explode(F.arrays_zip("cold", "times")).alias("x")).select("row", F.col("x.cold").alias("h"), F.col("x.times").alias("times"))
    met = cold.join(vocab.select("h", "c"), "h", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(n + v + 1)))).alias("cold_score"),
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("cold_known"),
    )
    return scored.join(met, "row", "left").select(
        F.col("id").alias("doc_id"),
        "n_tokens",
        (F.col("hot_known") + F.coalesce("cold_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("hot_score") + F.coalesce("cold_score", F.lit(0.0))).alias("base_score"),
        (F.col("ln") / math.log(10)).alias("score"),
        (-F.col("ln") / math.log(2) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(documents, crc32_mod("doc_id", 7) != 2)
    return scored.select("doc_id", (crc32_mod("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
