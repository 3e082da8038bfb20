"""Benchmark decontamination by winnowing.

A window is `WINDOW` consecutive words of an item; a shorter item is one window. Of each window of
training text and of each benchmark window, winnowing keeps the fingerprint with the least hash among
its word k-grams (the last one among equals). A window that stands in both has one minimum, so both
sides keep it: no shared window is missed. Fingerprints of a document are joined to those of the
benchmark, and each hit is extended to all the windows that hold it, which are compared word by word.

The benchmark's index is broadcast in blocks of at most `BLOCK_BYTES` of item text, its size checked
first. All documents are held against each block. With several blocks, documents are written once with a
row number, each block writes the rows that it hits, and only these are united and joined back, so a
benchmark of any size is matched whole and the memory of a task stays bounded. Texts don't move to meet
fingerprints, so copies and hot passages move no work between tasks.

Defined cases: null and empty texts have no words and no hits; an item without words has no window;
an item that stands there twice counts once (by item_id; a null one is the id ''); repeated documents
each get their row; an empty benchmark contaminates nothing; words are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlace.llm import textkit as tk
from kinlace.llm.tables import annotate, filtered, saved, scratch, table

WINDOW = 10
GRAM = 5
BLOCK_BYTES = 4 << 20
#: Bytes of text that are looked at together; passes over them hold some 40 bytes for each, in every worker.
SLICE_BYTES = 512 << 10
_FLAG_BITS = 20


def fingerprints(words: np.ndarray, rows: np.ndarray, k: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions that winnowing keeps, and the k-gram hashes of all positions; for windows of `length` words."""
    grams = tk.gram_hashes(words, k)
    n, width = len(words) - length + 1, length - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), grams
    least, at = grams[:n].copy(), np.zeros(n, dtype=np.int64)
    for j in range(1, width):
        g = grams[j : j + n]
        lower = g <= least
        least[lower] = g[lower]
        at[lower] = j
    whole = rows[:n] == rows[length - 1 :]
    kept = np.zeros(len(grams), dtype=bool)
    kept[(np.arange(n) + at)[whole]] = True
    return np.flatnonzero(kept), grams


class Windows:
    """A block's windows of one length."""

    def __init__(self, length: int, words: np.ndarray, rows: np.ndarray) -> None:
        """words: hashes of the words of the items that have windows of this length; rows: their item numbers."""
        self.length, self.k = length, min(GRAM, length)
        n = max(len(words) - length + 1, 0)
        starts = np.flatnonzero(rows[:n] == rows[length - 1 :])
        hashes = tk.gram_hashes(words, length)[starts] if n else np.zeros(0, dtype=np.uint64)
        pairs = np.unique(np.rec.fromarrays([hashes, rows[starts]], names="h,i"))
        self.hashes, first = np.unique(hashes, return_index=True)
        self.words = words[starts[first][:, None] + np.arange(length)] if n else np.zeros((0, length), dtype=np.uint64)
        self.item_off = np.append(np.searchsorted(pairs.h, self.hashes), len(pairs))
        self.items = pairs.i.astype(np.int64)
        kept, grams = fingerprints(words, rows, self.k, length)
        self.prints = np.unique(grams[kept])
        self.flags = np.zeros(1 << _FLAG_BITS, dtype=bool)
        self.flags[self.prints >> np.uint64(64 - _FLAG_BITS)] = True

    def find(self, words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows that occur in the text, and their numbers here."""
        none = np.zeros(0, dtype=np.int64)
        if not len(self.prints):
            return none, none
        kept, grams = fingerprints(words, rows, self.k, self.length)
        g = grams[kept]
        near = self.flags[g >> np.uint64(64 - _FLAG_BITS)]
        kept, g = kept[near], g[near]
        at = np.minimum(np.searchsorted(self.prints, g), len(self.prints) - 1)
        kept = kept[self.prints[at] == g]
        if not len(kept):
            return none, none
        # the windows that hold a fingerprint begin up to `length - k` words before it
        starts = np.unique((kept[:, None] - np.arange(self.length - self.k + 1)).ravel())
        starts = starts[(starts >= 0) & (starts <= len(words) - self.length)]
        starts = starts[rows[starts] == rows[starts + self.length - 1]]
        span = words[starts[:, None] + np.arange(self.length)]
        h = span[:, 0].copy()
        for j in range(1, self.length):
            h = h * tk._BASE + span[:, j]
        h = tk.mix(h)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        same = (self.words[at] == span).all(axis=1)
        return starts[same], at[same]


class Index:
    """A block of benchmark items."""

    def __init__(self, ids: list[str], texts: pa.Array) -> None:
        self.ids = ids
        words, rows = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
        for s in tk.slices(texts, lower=True, limit=SLICE_BYTES):
            starts, ends, row = s.words(tk.ALNUM_WORDS)
            words.append(tk.span_hashes(s.data, starts, ends))
            rows.append(row + s.rows.start)
        w, r = np.concatenate(words), np.concatenate(rows)
        size = np.minimum(np.bincount(r, minlength=max(len(ids), 1)), WINDOW)
        self.windows = [Windows(int(n), w[size[r] == n], r[size[r] == n]) for n in np.unique(size[size > 0])]

    def scan(self, texts: pa.Array) -> list[tuple[int, np.ndarray, list[str]]]:
        """For each text: its number of words, the numbers of the words that are hit, and the items that hit it."""
        out: list[tuple[int, np.ndarray, list[str]]] = []
        for s in tk.slices(texts, lower=True, limit=SLICE_BYTES):
            starts, ends, rows = s.words(tk.ALNUM_WORDS)
            words = tk.span_hashes(s.data, starts, ends)
            n_words = np.bincount(rows, minlength=s.n)
            first = np.concatenate([[0], np.cumsum(n_words)])
            cover = np.zeros(len(words) + 1, dtype=np.int64)
            items: dict[int, set[str]] = {}
            for w in self.windows:
                at, number = w.find(words, rows)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + w.length, -1)
                for row, x in np.unique(np.stack([rows[at], number], axis=1), axis=0).tolist() if len(at) else ():
                    items.setdefault(row, set()).update(self.ids[i] for i in w.items[w.item_off[x] : w.item_off[x + 1]])
            hit = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
            cuts = np.searchsorted(hit, first)
            out += [(int(n_words[i]), hit[cuts[i] : cuts[i + 1]] - first[i], sorted(items.get(i, ()))) for i in range(s.n)]
        return out


def benchmark_blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES):
    """Indexes of the benchmark's blocks, one after the other; each has about block_bytes of text, or one item."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / block_bytes))
    for b in range(n):
        got = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b).orderBy("item", "text").toArrow()
        yield Index(got.column("item").to_pylist(), got.column("text").combine_chunks()), n


def _scanned(docs: DataFrame, text_col: str, index: Index, tag: str = "__") -> tuple[DataFrame, Broadcast]:
    """docs with words, hits and items of one block, tag before their names; the broadcast is the caller's to give back."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def work(texts: pa.Array) -> list[pa.Array]:
        found = shared.value.scan(texts)
        return [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1].tolist() for x in found], pa.list_(pa.int32())), pa.array([x[2] for x in found], pa.list_(pa.string()))]

    return annotate(docs, text_col, work, f"{tag}words long, {tag}hits array<int>, {tag}items array<string>"), shared


def _hits_of_blocks(rows: DataFrame, blocks: Iterator[tuple[Index, int]], folder: str) -> list[DataFrame]:
    """Of each block: row, __words, __hits, __items of the rows that it hits (the first block: of all). rows: row, text."""
    out = []
    for k, (index, _) in enumerate(blocks):  # the block before has gone; only one is held at a time
        made, shared = _scanned(rows, "text", index)
        made = made.select("row", "__words", "__hits", "__items")
        out.append(saved(made.filter("size(__hits) > 0") if k else made, f"{folder}/block-{k}"))
        shared.destroy()
    return out


def _numbered(documents: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame, str]:
    """documents with a row number, written once, as (d: all columns, row); its texts (row, text); and the folder."""
    folder = scratch(documents.sparkSession, "decontaminate")
    whole = saved(documents.select(F.struct(*documents.columns).alias("d"), F.monotonically_increasing_id().alias("row")), f"{folder}/documents")
    return whole, whole.select("row", F.col("d").getField(text_col).cast("string").alias("text")), folder


def contamination(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of documents, n_words, n_hit, hit_words (numbers of the words that are hit) and items. A column of
    documents that has one of these names is left out."""
    blocks = benchmark_blocks(benchmark, block_bytes=block_bytes)
    first, n = next(blocks)
    new = ("n_words", "n_hit", "hit_words", "items")
    names = [c for c in documents.columns if c not in new]
    if n == 1:
        tag = "__"
        while any(c.startswith(tag) for c in names):
            tag += "_"
        found, _ = _scanned(documents.select(*names), text_col, first, tag)
        words, hits, items, kept = F.col(f"{tag}words"), F.col(f"{tag}hits"), F.col(f"{tag}items"), [F.col(c) for c in names]
    else:
        rows, texts, folder = _numbered(documents.select(*names), text_col)
        parts = _hits_of_blocks(texts, chain([(first, n)], blocks), folder)
        # only the rows that are hit are united; each has as many rows here as blocks that hit it
        united = reduce(DataFrame.unionByName, [p.filter("size(__hits) > 0") for p in parts]).groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("__hits"))).alias("__hits"), F.array_distinct(F.flatten(F.collect_list("__items"))).alias("__items"))
        found = rows.join(parts[0].select("row", "__words"), "row").join(united, "row", "left")
        words, hits, items = F.col("__words"), F.coalesce("__hits", F.array().cast("array<int>")), F.coalesce("__items", F.array().cast("array<string>"))
        kept = [F.col("d").getField(c).alias(c) for c in names]
    return found.select(*kept, words.alias("n_words"), F.size(hits).cast("long").alias("n_hit"), F.array_sort(hits).alias("hit_words"), F.array_sort(items).alias("items"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of documents without any hit, with their own columns only."""
    blocks = benchmark_blocks(benchmark, block_bytes=block_bytes)
    first, n = next(blocks)
    if n == 1:
        shared = documents.sparkSession.sparkContext.broadcast(first)
        return filtered(documents, text_col, lambda texts: np.array([not len(x[1]) for x in shared.value.scan(texts)], dtype=bool))
    rows, texts, folder = _numbered(documents, text_col)
    parts = _hits_of_blocks(texts, chain([(first, n)], blocks), folder)
    gone = reduce(DataFrame.unionByName, [p.filter("size(__hits) > 0").select("row") for p in parts])
    return rows.join(gone, "row", "left_anti").select(*[F.col("d").getField(c).alias(c) for c in documents.columns])


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_sql() -> str:
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
b AS (SELECT item_id, {words} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS gram
  FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) AS i) WHERE len(w) > 0
), lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM d, lens, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i) WHERE len(w) >= n
), hits AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw ON dw.gram = bw.gram AND dw.n = bw.n),
marked AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hits, LATERAL (SELECT unnest(range(0, n)) AS j) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(DISTINCT item_id::VARCHAR) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
  FROM hits GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN found USING (doc_id)
"""
