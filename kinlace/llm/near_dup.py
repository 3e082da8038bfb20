"""Near-duplicate classes by order min-hash and banded alignment.

A text is the sequence of its lower-case words. Its k-mers are runs of `k` words, each labelled with how
many equal ones stand before it. A sketch takes the `l` labelled k-mers with the least hashes under
its seed, in text order, so texts share a sketch with a chance that grows with their edit similarity.
Texts that share any sketch are candidates. A candidate pair is a link if a banded alignment of the two
whole word sequences has at most (1 - similarity) * longer length edits. Classes are the connected
components of all links.

Equal sequences are one node, by a hash, from the start. Within a bucket (a sketch's texts), a text
of the shortest length class leads first, and those of another class are compared with it. The first few
sketches alone make most classes; from then on, only buckets of texts of several classes count. After each
round, links between texts become links between classes, so what is joined in the next rounds are classes.

What several classes then still share is compared in full. Buckets with the same least text are one
bundle, and all pairs of a bundle that are of unlike classes and whose lengths allow a link are compared:
a bundle of many texts is dealt by length into blocks, and each task compares two blocks of lengths that allow
a link, first by the words that two texts can have in common at most. So texts that share a sketch are parted only by an
alignment or a bound on it, never by the choice of a leader, and no bucket is capped or dropped. Rounds are
written to the shared folder.

Defined cases: null, empty and wordless texts are a class each; a text of fewer than k words has one
k-mer, all its words; equal texts are always of one class; a row with a null id has no class (null); rows
of equal id are one document; an empty table gives no rows; other columns are ignored.
Words are compared by 32 bits of their hash in the alignment, and sequences by 128 bits: a node is 64 bits of
these, and texts that share them by chance are parted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinlace.llm import textkit as tk
from kinlace.llm.tables import annotate, drop_scratch, key_filter, saved, scratch, shared_dir, table

K = 5
L = 2
SKETCHES = 96
#: Sketches of the rounds of leaders: those below each number that were in no round before, then all others.
ROUNDS = (6,)
SIMILARITY = 0.8
#: Most texts of a block on average, and most words of them.
BLOCK_TEXTS = 1024
BLOCK_WORDS = 1 << 22
#: Most pairs of one leader that a task gets from one place.
LEADER_PAIRS = 512
#: Most bytes of the word counts of a task's texts.
COUNT_BYTES = 64 << 20
#: Bytes of text that are looked at together; passes over them hold some 40 bytes for each.
SLICE_BYTES = 1 << 20
#: Bytes of word counts that are looked at together.
COUNT_STEP = 1 << 20

_U = np.uint64


def _seeds(n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    base = tk.mix((np.arange(1, 2 * n + 1, dtype=np.uint64) + _U(salt << 32)) * _U(0x9E3779B97F4A7C15))
    return base[:n], base[n:] | _U(1)


def sketch_slice(s: tk.Slice, k: int, l: int, n_sketches: int) -> dict[str, np.ndarray]:
    """n_words, two hashes of the sequence, and sketches (n_sketches a row; wordless rows: zeros)."""
    starts, ends, rows = s.words(tk.ALNUM_WORDS)
    words = tk.span_hashes(s.data, starts, ends)
    n_words = np.bincount(rows, minlength=s.n).astype(np.int64)
    out = {"n_words": n_words, "h1": np.zeros(s.n, np.uint64), "h2": np.zeros(s.n, np.uint64), "sketches": np.zeros((s.n, n_sketches), np.uint64)}
    full = np.flatnonzero(n_words)
    if not len(full):
        return out
    size = n_words[full]
    first = np.cumsum(size) - size
    out["h1"][full], out["h2"][full] = sequence_hashes(words, size)
    # k-mers: k words, or all of a shorter text
    grams = np.zeros(len(words), dtype=np.uint64)
    grams[: max(len(words) - k + 1, 0)] = tk.gram_hashes(words, k)
    short = size < k
    n_grams = np.where(short, 1, size - k + 1)
    g = grams[tk.ranges(first, n_grams)]
    g[(np.cumsum(n_grams) - n_grams)[short]] = out["h1"][full][short]
    out["sketches"][full] = order_min_hash(labelled(g, np.repeat(np.arange(len(full)), n_grams)), n_grams, l, n_sketches)
    return out


def sequence_hashes(words: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each row's whole sequence; every row has words."""
    first = np.cumsum(size) - size
    power = tk._POWERS.upto(int(size.max()) + 1)[np.arange(len(words), dtype=np.int64) - np.repeat(first, size)]
    one, two = (np.add.reduceat(turn * power, first) + size.astype(np.uint64) for turn in (words, tk.mix(words ^ _U(0xA5A5A5A5A5A5A5A5))))
    return tk.mix(one), tk.mix(two)


def node_of(h1: np.ndarray, h2: np.ndarray, twice: dict[int, int]) -> np.ndarray:
    """h1, but h2 where another sequence has the same h1. twice: h1 -> the h2 that keeps it."""
    out = h1.view(np.int64).copy()
    if twice:
        h2 = h2.view(np.int64)
        for i in np.flatnonzero(np.isin(out, np.array(list(twice), dtype=np.int64))).tolist():
            if h2[i] != twice[int(out[i])]:
                out[i] = h2[i]
    return out


def labelled(grams: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """k-mer hashes that also tell how many equal ones stand before in the row."""
    keys = tk.by_row(grams, rows)
    order = np.argsort(keys, kind="stable")
    run = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
    begin = np.maximum.accumulate(np.where(run, np.arange(len(order)), 0))
    label = np.empty(len(order), dtype=np.uint64)
    label[order] = (np.arange(len(order)) - begin).astype(np.uint64)
    return tk.mix(grams + label * _U(0xC2B2AE3D27D4EB4F))


def order_min_hash(g: np.ndarray, n_grams: np.ndarray, l: int, n_sketches: int, salt: int = 0) -> np.ndarray:
    """Sketches of rows of n_grams >= 1 labelled k-mers each; a row of fewer than l takes its first again."""
    first = np.cumsum(n_grams) - n_grams
    rows = np.repeat(np.arange(len(n_grams)), n_grams)
    out = np.empty((len(n_grams), n_sketches), dtype=np.uint64)
    top = _U(2**64 - 1)
    xors, odds = _seeds(n_sketches, salt)
    for j in range(n_sketches):
        h = (g ^ xors[j]) * odds[j]
        picks = []
        for _ in range(l):
            least = np.minimum.reduceat(h, first)
            hit = np.flatnonzero(h == np.repeat(least, n_grams))
            _, one = np.unique(rows[hit], return_index=True)
            picks.append(np.where(least == top, first, hit[one]))
            h[hit[one]] = top
        value = np.full(len(n_grams), _U(j + 1))
        for p in np.sort(np.stack(picks), axis=0):  # text order
            value = tk.mix(value * _U(0x9FB21C651E98DF25) + g[p])
        out[:, j] = value
    return out


def sketches(documents: DataFrame, text_col: str, k: int, l: int, n_sketches: int) -> DataFrame:
    """documents with n_words, h1, h2, sketches array<long>."""

    def work(texts: pa.Array) -> list[pa.Array]:
        parts = [sketch_slice(s, k, l, n_sketches) for s in tk.slices(texts, lower=True, limit=SLICE_BYTES)]
        if not parts:
            return [pa.array([], pa.int64())] * 3 + [pa.array([], pa.list_(pa.int64()))]
        cat = {n: np.concatenate([p[n] for p in parts]) for n in parts[0]}
        n = len(cat["n_words"])
        flat = pa.array(cat["sketches"].view(np.int64).ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * n_sketches), flat)
        return [pa.array(cat["n_words"]), pa.array(cat["h1"].view(np.int64)), pa.array(cat["h2"].view(np.int64)), lists]

    return annotate(documents, text_col, work, "n_words long, h1 long, h2 long, sketches array<long>")


def sequences(texts: DataFrame, wanted: tk.KeyFilter, twice: dict[int, int]) -> DataFrame:
    """node, seq (32 bits of each word's hash) of the texts whose node `wanted` passes, once a batch."""
    shared = texts.sparkSession.sparkContext.broadcast(wanted)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, out = [np.zeros(0, dtype=np.int64)], []
            for s in tk.slices(batch.column(0), lower=True, limit=SLICE_BYTES):
                starts, ends, rows = s.words(tk.ALNUM_WORDS)
                if not len(rows):
                    continue
                words = tk.span_hashes(s.data, starts, ends)
                size = np.bincount(rows, minlength=s.n)
                node = node_of(*sequence_hashes(words, size[size > 0]), twice)
                cuts = np.concatenate([[0], np.cumsum(size[size > 0])])
                words = (words >> _U(32)).astype("<u4")
                node, first = np.unique(node, return_index=True)
                kept = np.flatnonzero(shared.value.has(node))
                nodes.append(node[kept])
                out += [words[cuts[i] : cuts[i + 1]].tobytes() for i in first[kept].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(out, pa.binary())], names=["node", "seq"])
        tk.release()

    return texts.mapInArrow(run, "node long, seq binary")


def filtered_nodes(df: DataFrame, wanted: tk.KeyFilter) -> DataFrame:
    """The rows of df (node, seq) whose node `wanted` passes."""
    shared = df.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.has(batch.column(0).to_numpy())))

    return df.select("node", "seq").mapInArrow(run, "node long, seq binary")


def shared_sketches(nodes: DataFrame, wanted: tk.KeyFilter) -> DataFrame:
    """node, n, j, bucket: the sketches of nodes (node, n, sketches) that `wanted` passes, and each one's number j, once a batch."""
    shared = nodes.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, first = np.unique(batch.column(0).to_numpy(), return_index=True)
            batch = batch.take(pa.array(first))
            lists = batch.column(2)
            size = np.diff(np.asarray(lists.offsets))
            flat = lists.flatten().to_numpy()
            hit = np.flatnonzero(shared.value.has(flat))
            row = np.repeat(np.arange(len(size)), size)[hit]
            j = hit - np.repeat(np.cumsum(size) - size, size)[hit]
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(j, pa.int32()), pa.array(flat[hit], pa.int64())], names=["node", "n", "j", "bucket"])

    return nodes.mapInArrow(run, "node long, n long, j int, bucket long")


def banded_distance(a: np.ndarray, b: np.ndarray, limit: int) -> int:
    """Edit distance of two sequences if it is at most `limit`, else limit + 1.

    Columns of the alignment are bit vectors of vertical steps over the 2 * limit + 1 rows around the
    diagonal, held in one integer each and moved down by a row with every column (after Myers and Hyyro)."""
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    head = n if same.all() else int(np.argmin(same))
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    if n:
        same = a[len(a) - n :][::-1] == b[len(b) - n :][::-1]
        tail = n if same.all() else int(np.argmin(same))
        a, b = a[: len(a) - tail], b[: len(b) - tail]
    if len(a) < len(b):
        a, b = b, a
    m, n = len(a), len(b)
    if m - n > limit:
        return limit + 1
    if not n:
        return m
    # a word can only be aligned with an equal one
    x, y = np.sort(a), np.sort(b)
    values, counts = np.unique(y, return_counts=True)
    common = int(np.minimum(counts, np.searchsorted(x, values, "right") - np.searchsorted(x, values, "left")).sum())
    if m - common > limit:
        return limit + 1
    k = min(limit, m)
    width = 2 * k + 1
    mask = (1 << width) - 1
    rows: dict[int, int] = {}
    for r, v in enumerate(a.tolist()):
        rows[v] = rows.get(v, 0) | (1 << r)
    # bit t of column j is row j + t - k of a; rows above a's first have no step
    up = mask ^ ((1 << k) - 1)
    down = 0
    bottom = 1 << (2 * k)
    score, last = k, m - k  # score: the cell at the band's lower edge, then in a's last row
    if last <= 0:
        score, last = m, 0
    row_bit = m - 1 + k
    for j, v in enumerate(b.tolist()):
        eq = rows.get(v, 0)
        eq = (eq >> (j - k) if j >= k else eq << (k - j)) & mask
        zero = ((((eq & up) + up) ^ up) | eq | down) & mask
        right = down | (mask ^ ((zero | up) & mask))
        left = zero & up
        if j < last:
            score += not zero & bottom
        else:
            bit = 1 << (row_bit - j)
            score += bool(right & bit)
            score -= bool(left & bit)
        shifted = zero >> 1
        up = (left | (mask ^ ((shifted | right) & mask))) & mask
        down = shifted & right
    return min(score, limit + 1)


def edit_limit(n: int, similarity: float) -> int:
    """Most edits that two texts may have whose longer one has n words."""
    return int((1 - similarity) * n + 1e-9)


def _release(group: pa.Table) -> None:
    """A worker is kept after its groups, with what large ones took."""
    if group.nbytes > COUNT_STEP:
        tk.release()


def _align(ends: DataFrame, similarity: float) -> DataFrame:
    """a, b, la, lb, linked. ends: a, salt (a group), node, la, lb, seq; a group's leader is the row whose node is a."""

    def run(t: pa.Table) -> pa.Table:
        node, a = t.column("node").to_numpy(), t.column("a")[0].as_py()
        lead = np.frombuffer(t.column("seq")[int(np.flatnonzero(node == a)[0])].as_py(), "<u4")
        others = t.filter(pa.array(node != a))
        linked = []
        for q in others.column("seq"):
            y = np.frombuffer(q.as_py(), "<u4")
            limit = edit_limit(max(len(lead), len(y)), similarity)
            linked.append(banded_distance(lead, y, limit) <= limit)
        _release(t)
        return pa.table({"a": others.column("a"), "b": others.column("node"), "la": others.column("la"), "lb": others.column("lb"), "linked": pa.array(linked, pa.bool_())})

    return ends.groupBy("a", "salt").applyInArrow(run, "a long, b long, la long, lb long, linked boolean")


def word_counts(seqs: list[np.ndarray]) -> np.ndarray:
    """A row a sequence: how many of its words fall to each bin. The sum of two rows' least is at least the
    number of words that the sequences have in common."""
    longest = max(len(x) for x in seqs)
    kind = np.uint8 if longest < 1 << 8 else np.uint16 if longest < 1 << 16 else np.uint32
    most = max(COUNT_BYTES // (len(seqs) * np.dtype(kind).itemsize), 256)
    bins = min(1 << (2 * longest).bit_length(), 1 << (most.bit_length() - 1), 1 << 16)
    return np.stack([np.bincount(x & (bins - 1), minlength=bins).astype(kind) for x in seqs])


def block_links(labels: list, seqs: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Linked pairs of texts of unlike labels, one of `left` and one of `right` (of each two, if these are the
    same), that join labels which no pair before has joined."""
    parent: dict = {x: x for x in labels}

    def find(x):  # noqa: ANN001, ANN202
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    size = np.array([len(x) for x in seqs])
    limits = np.array([edit_limit(int(x), similarity) for x in size])
    least = size - limits  # of words in common, if this one is the longer
    names = {x: i for i, x in enumerate(parent)}
    classes = np.array([names[x] for x in labels])
    counts = word_counts(seqs)
    one = left is right
    out = []
    for at, i in enumerate(left.tolist()):
        others = right[at + 1 :] if one else right
        longer = np.where(size[others] > size[i], least[others], least[i])
        others, longer = (x[(classes[others] != classes[i]) & (np.minimum(size[others], size[i]) >= longer)] for x in (others, longer))
        if not len(others):
            continue
        step = max(COUNT_STEP // (counts.shape[1] * counts.itemsize), 1)
        common = np.concatenate([np.minimum(counts[others[k : k + step]], counts[i]).sum(axis=1, dtype=np.int64) for k in range(0, len(others), step)])
        for j in others[common >= longer].tolist():
            if find(labels[i]) == find(labels[j]):
                continue
            limit = int(max(limits[i], limits[j]))
            if banded_distance(seqs[i], seqs[j], limit) <= limit:
                parent[find(labels[i])] = find(labels[j])
                out.append((i, j))
    return out


def _links(blocks: DataFrame, similarity: float) -> DataFrame:
    """la, lb: the labels that block_links joins. blocks: bundle, p, q (two blocks), block (the text's own), label, seq."""

    def run(t: pa.Table) -> pa.Table:
        p, q = (t.column(c)[0].as_py() for c in "pq")
        block = t.column("block").to_numpy()
        left = np.flatnonzero(block == p)
        right = left if p == q else np.flatnonzero(block == q)
        seqs = [np.frombuffer(x, "<u4") for x in t.column("seq").to_pylist()]
        found = block_links(t.column("label").to_pylist(), seqs, left, right, similarity)
        label = t.column("label").combine_chunks()
        _release(t)
        return pa.table({"la": label.take(pa.array([x for x, _ in found], pa.int64())), "lb": label.take(pa.array([y for _, y in found], pa.int64()))})

    return blocks.groupBy("bundle", "p", "q").applyInArrow(run, "la long, lb long")


def components(edges: DataFrame, folder: str) -> DataFrame:
    """node, label of the nodes of edges (a, b): the least node of its component. Least labels go along edges,
    and each label's own label is taken in the same round, so paths halve; rounds are written to folder."""
    spark = edges.sparkSession
    both = saved(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{folder}/edges")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")), f"{folder}/labels-0")
    n = 0
    while True:
        n += 1
        sent = both.join(labels, F.col("a") == F.col("node")).select(F.col("b").alias("node"), "label")
        jumped = labels.join(labels.select(F.col("node").alias("label"), F.col("label").alias("next")), "label").select("node", F.col("next").alias("label"))
        fresh = saved(sent.unionByName(jumped).unionByName(labels).groupBy("node").agg(F.min("label").alias("label")), f"{folder}/labels-{n}")
        changed = fresh.join(labels.withColumnRenamed("label", "old"), "node").filter(F.col("label") != F.col("old"))
        if changed.isEmpty():
            return spark.read.parquet(f"{folder}/labels-{n}")
        labels = fresh


class NearDuplicates:
    """The steps, with their tables in a folder that all executors share."""

    def __init__(self, documents: DataFrame, id_col: str, text_col: str, k: int = K, l: int = L, n_sketches: int = SKETCHES, similarity: float = SIMILARITY) -> None:
        self.spark, self.similarity = documents.sparkSession, similarity
        shared_dir(self.spark)
        self.folder = scratch(self.spark, "near-dup")
        docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        self.texts = docs.filter("id IS NOT NULL").select("text")
        sketched = saved(sketches(docs, "text", k, l, n_sketches).drop("text"), self._path("sketched"))
        worded = (F.col("n_words") > 0) & F.col("id").isNotNull()
        clash = sketched.filter(worded).groupBy("h1").agg(F.min("h2").alias("lo"), F.max("h2").alias("hi")).filter("lo <> hi")
        self.twice = {r["h1"]: r["lo"] for r in clash.collect()}  # chance alone makes these: some 70 of 5e10 texts
        node = F.col("h1")
        if self.twice:
            lo = F.create_map(*[F.lit(x).cast("long") for pair in self.twice.items() for x in pair])[F.col("h1")]
            node = F.when(F.col("h2") != lo, F.col("h2")).otherwise(F.col("h1"))
        self.rows = saved(sketched.select("id", "n_words", F.when(worded, node).alias("node")), self._path("ids"))
        self.sketched = sketched.filter(worded).select(node.alias("node"), F.col("n_words").alias("n"), "sketches")

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def labels(self) -> DataFrame:
        """node, label: the least node of its class for each node that any other is linked to."""
        every = self.sketched.select("node", F.explode("sketches").alias("bucket"))
        shared = every.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi").select("bucket")
        shared = saved(shared, self._path("shared"))
        # few sketches are shared, so the others go before the join moves them
        rows = saved(shared_sketches(self.sketched, key_filter(shared)).join(shared, "bucket").distinct(), self._path("rows"))
        drop_scratch(self.spark, self._path("sketched"))
        # nodes that share no sketch are done; the others' sequences are made once
        self.seqs = saved(sequences(self.texts, key_filter(rows.select("node")), self.twice).dropDuplicates(["node"]), self._path("seqs"))
        # rows of one id are one document
        several = self.rows.filter("node IS NOT NULL").groupBy("id").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi")
        same = saved(self.rows.filter("node IS NOT NULL").join(several, "id").select(F.col("lo").alias("la"), F.col("node").alias("lb")), self._path("same-id"))
        labels, aligned, at = None, [], 0
        for to in (*ROUNDS, None):
            some = rows.filter((F.col("j") >= at) & (F.col("j") < to if to else F.lit(True)))
            aligned.append(self._compare(self._candidates(some, labels, f"{at}"), aligned, f"{at}"))
            labels = self._merged(labels, aligned[-1].filter("linked"), f"{at}")
            at = to
        found = saved(_links(self._blocks(rows, labels), self.similarity), self._path("links"))
        labels = self._merged(labels, found, "blocks")
        return labels if same.isEmpty() else self._merged(labels, same, "ids")

    def _merged(self, labels: DataFrame | None, links: DataFrame, name: str) -> DataFrame:
        """node, label after links (la, lb) between labels."""
        links = links.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).filter("a <> b").distinct()
        found = components(links, self._path(f"components-{name}"))
        if labels is None:
            return found
        moved = labels.join(found.toDF("label", "least"), "label", "left").select("node", F.coalesce("least", "label").alias("label"))
        lone = found.join(labels.select("node"), "node", "left_anti")  # had no link before
        return saved(moved.unionByName(lone), self._path(f"labels-{name}"))

    def _members(self, rows: DataFrame, labels: DataFrame | None, lead: Column, name: str) -> DataFrame:
        """rows (node, n, bucket) with label, of the buckets of texts of several classes, and the least of `lead` in the bucket. labels: node, label."""
        known = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")) if labels is not None else rows.withColumn("label", F.col("node"))
        # least values are taken within tasks first, so a hot bucket is a row a task
        some = known.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min(lead).alias("lead")).filter("lo <> hi")
        return saved(known.join(saved(some.select("bucket", "lead"), self._path(f"buckets-{name}")), "bucket"), self._path(f"members-{name}"))

    def _place(self) -> Column:
        """The length class: texts of a link are of the same or of neighbouring ones."""
        return F.floor(F.log("n") / math.log(1 / self.similarity) + 1e-9).cast("int")

    def _blocks(self, rows: DataFrame, labels: DataFrame) -> DataFrame:
        """What _links asks for: each text of a bundle of buckets of several classes, once for each two blocks that it is in."""
        full = self._members(rows.select("node", "n", "bucket").distinct(), labels, F.col("node"), "blocks")
        full = saved(full.select(F.col("lead").alias("bundle"), "node", "n", "label").distinct(), self._path("bundles"))
        # a bundle that fits is one block; others are dealt into blocks by length, and texts of one length by hash
        size = full.groupBy("bundle").agg(F.count("*").alias("m"), F.sum("n").alias("words")).filter(f"m > {BLOCK_TEXTS} OR words > {BLOCK_WORDS}").select("bundle")
        size = saved(size, self._path("large-bundles"))
        zero = F.lit(0).cast("long")
        small = full.join(size, "bundle", "left_anti").select("bundle", zero.alias("p"), zero.alias("q"), zero.alias("block"), "node", "label")
        large = full.join(size, "bundle")
        weight = F.greatest(F.col("n"), F.lit(max(BLOCK_WORDS // BLOCK_TEXTS, 1)))
        before = F.coalesce(F.sum("weight").over(Window.partitionBy("bundle").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        lengths = saved(large.groupBy("bundle", "n").agg(F.sum(weight).alias("weight"), F.count("*").alias("texts")), self._path("lengths"))
        lengths = lengths.withColumn("before", before).select("bundle", "n", "before", "texts")
        place = F.col("before") + weight * F.pmod(F.xxhash64("node", F.lit("salt")), F.col("texts"))
        large = large.join(lengths, ["bundle", "n"]).select("bundle", F.floor(place / BLOCK_WORDS).alias("block"), "node", "label", "n")
        large = saved(large, self._path("large"))
        blocks = large.groupBy("bundle", "block").agg(*(f(c).alias(f"{name}_{c}") for c in ("n", "label") for f, name in ((F.min, "lo"), (F.max, "hi"))))
        blocks = saved(blocks, self._path("blocks"))
        x, y = blocks.alias("x"), blocks.alias("y")
        # two blocks meet if their lengths allow a link (edit_limit), and they hold several classes
        least = F.col("y.lo_n") - F.floor((1 - self.similarity) * F.col("y.lo_n") + 1e-9)
        several = F.least("x.lo_label", "y.lo_label") != F.greatest("x.hi_label", "y.hi_label")
        pairs = x.join(y, (F.col("x.bundle") == F.col("y.bundle")) & (F.col("x.block") <= F.col("y.block")) & (F.col("x.hi_n") >= least)).filter(several)
        pairs = pairs.select("x.bundle", F.col("x.block").alias("p"), F.col("y.block").alias("q"))
        pairs = saved(pairs.select("bundle", "p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("block")), self._path("block-pairs"))
        large = large.join(pairs, ["bundle", "block"])
        both = saved(small.unionByName(large.select("bundle", "p", "q", "block", "node", "label")), self._path("block-members"))
        return both.join(self._needed(both), "node")

    def _candidates(self, rows: DataFrame, labels: DataFrame | None, name: str) -> DataFrame:
        """a, b, la, lb: the leader of each bucket with each of its texts of another class, and their labels."""
        full = self._members(rows, labels, F.struct(self._place().alias("place"), "node", "label"), name).filter(F.col("label") != F.col("lead.label"))
        pairs = full.select(F.col("lead.node").alias("a"), F.col("node").alias("b"), F.col("lead.label").alias("la"), F.col("label").alias("lb"))
        return saved(pairs.distinct(), self._path(f"candidates-{name}"))

    def _compare(self, pairs: DataFrame, before: list[DataFrame], name: str) -> DataFrame:
        """Alignments of pairs (a, b, la, lb) that weren't compared before."""
        if before:
            pairs = saved(pairs.join(reduce(DataFrame.unionByName, before).select("a", "b"), ["a", "b"], "left_anti"), self._path(f"new-{name}"))
        many = pairs.groupBy("a").agg(F.ceil(F.count("*") / LEADER_PAIRS).alias("salts"))
        # the pairs of a leader of many are dealt by salt, and its sequence goes to each salt once
        dealt = saved(pairs.join(many, "a").withColumn("salt", F.pmod(F.xxhash64("b"), "salts")).drop("salts"), self._path(f"dealt-{name}"))
        leaders = dealt.select("a", "salt").distinct().select("a", "salt", F.col("a").alias("node"), F.lit(None).cast("long").alias("la"), F.lit(None).cast("long").alias("lb"))
        ends = leaders.unionByName(dealt.withColumnRenamed("b", "node"))
        return saved(_align(ends.join(self._needed(ends), "node"), self.similarity), self._path(f"aligned-{name}"))

    def _needed(self, rows: DataFrame) -> DataFrame:
        """The sequences of the nodes of rows, and few others."""
        return filtered_nodes(self.seqs, key_filter(rows.select("node")))

    def classes(self) -> DataFrame:
        """id, n_words, class_id for each row of documents."""
        least = self.rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("least"))
        least = saved(least, self._path("least"))
        labels = self.labels()
        linked = labels.join(least, "node")
        of_label = linked.groupBy("label").agg(F.min("least").alias("class_id"))
        linked = saved(linked.join(of_label, "label").select("node", "class_id"), self._path("classes"))
        every = least.join(linked, "node", "left").select("node", F.coalesce("class_id", "least").alias("class_id"))
        return self.rows.join(every, "node", "left").select("id", "n_words", F.when(F.col("id").isNotNull(), F.coalesce("class_id", "id")).alias("class_id"))


def near_duplicate_classes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, n_sketches: int = SKETCHES, k: int = K, l: int = L) -> DataFrame:
    """doc_id, n_words, class_id (the least id of its class) for each row of documents."""
    return NearDuplicates(documents, id_col, text_col, k, l, n_sketches, similarity).classes().withColumnRenamed("id", "doc_id")


def drop_near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The documents that give their class its id, with all their columns: one row of each class stays, and rows without an id."""
    spark, names = documents.sparkSession, documents.columns
    classes = saved(near_duplicate_classes(documents, id_col, text_col, similarity), scratch(spark, "classes"))
    key = F.col(id_col)
    gone = saved(classes.filter(F.col("doc_id") != F.col("class_id")).select(F.col("doc_id").alias("__gone")).distinct(), scratch(spark, "gone"))
    kept = documents.join(gone, key == F.col("__gone"), "left_anti")
    again = saved(classes.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__again")).agg(F.count("*").alias("n")).filter("n > 1").select("__again"), scratch(spark, "again"))
    if not again.isEmpty():  # rows of one id are one document: the least row stands
        place = F.row_number().over(Window.partitionBy(id_col).orderBy(*[F.col(c).cast("string") for c in names]))
        once = kept.join(again, key == F.col("__again"), "left_semi").withColumn("__n", place).filter("__n = 1").drop("__n")
        kept = kept.join(again, key == F.col("__again"), "left_anti").unionByName(once)
    return kept.select(*names)


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicate_classes(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id") == F.col("class_id"))
