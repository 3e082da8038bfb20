"""Content-addressed store of token ids.

Each document's ids (with the end id) are cut into chunks where a rolling hash over the last `ROLL` ids
meets a mask, so equal passages give equal chunks wherever they stand. A chunk's address is the sha256
of its ids as little-endian unsigned 32-bit integers. The store's folder holds

  blobs/kind=chunk    digest, payload (ids in `width` bytes each), n_ids: each unique chunk once
  recipes/            doc_id, start, n_tokens, digests, sizes, root: in ascending doc_id order (or that of a column) by part number
  manifest/           part, n_docs, n_tokens, root: Merkle roots over the parts' document roots, and part -1 for the whole

A task drops chunks that it has sent already, and only then are chunks shuffled by address, so a chunk
that a third of all documents share reaches its partition once per task. There they are sorted, and one stays. Texts and payloads are never
sorted by document: recipes are small, and start offsets come from sums per part.

Defined cases: null and empty texts have the end id alone; null ids stand first; repeated ids stand
side by side, ordered by root; an empty table gives an empty store; other columns are ignored.
Words are remembered by a 64-bit hash of their bytes. A vocabulary whose rules of parting text aren't those that
`pieces` knows is used on whole texts, one by one.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinlace.llm import textkit as tk
from kinlace.llm.tables import scratch, table

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
ROLL = 16
MEAN_CHUNK = 512
MAX_CHUNK = 4096
#: Distinct words that a worker remembers, at some 30 bytes each.
CACHE_WORDS = 1_000_000
#: Text that is encoded together.
ENCODE_BYTES = 1 << 20

_BLANK, _LETTER, _DIGIT, _MARK, _OTHER = range(5)
_KIND = np.full(256, _MARK, dtype=np.uint8)
_KIND[[0x09, 0x0A, 0x0D, 0x20]] = _BLANK
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _LETTER
_KIND[0x80:] = _OTHER
_KIND[[*range(0x00, 0x09), 0x0B, 0x0C, *range(0x0E, 0x20), 0x7F]] = _OTHER
_WHOLE = np.zeros(256, dtype=np.int8)
_WHOLE[[0x27, 0x3C]] = 1
#: Bytes of a-z and of the Latin-1 letters.
_PLAIN = np.zeros(256, dtype=bool)
_PLAIN[0x61:0x7B] = _PLAIN[0xC3] = _PLAIN[0x80:0xC0] = True
_PLAIN[[0x97, 0xB7]] = False


def pieces(s: tk.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text bytes with ASCII in lower case, and starts, ends and rows of pieces that are encoded on their own.

    The tokenizer parts tokens at blanks, and between ASCII letters, digits and marks wherever no apostrophe (whose
    endings are tokens) or < (that may open a token string) is in the word; such words stay whole, and as they are."""
    kind = _KIND[s.data]
    starts, ends, rows = s.words(_KIND != _BLANK)
    special = np.concatenate([[0], np.cumsum(_WHOLE[s.data], dtype=np.int64)])
    odd = np.flatnonzero(special[ends] > special[starts])
    data = tk._LOWER[s.data]
    turn = (kind[1:] != kind[:-1]) & (kind[1:] < _OTHER) & (kind[:-1] < _OTHER) & (kind[1:] > _BLANK) & (kind[:-1] > _BLANK)
    if len(odd):
        inside = tk.ranges(starts[odd], ends[odd] - starts[odd])
        data[inside] = s.data[inside]
        turn[inside[inside < len(turn)]] = False
    cuts = np.flatnonzero(turn) + 1
    if len(cuts):
        # a cut between two rows parts no word
        cuts = cuts[s.off[np.searchsorted(s.off, cuts)] != cuts]
        starts = np.sort(np.concatenate([starts, cuts]), kind="stable")
        ends = np.sort(np.concatenate([ends, cuts]), kind="stable")
        rows = s.row_of(starts)
    return data, starts, ends, rows


# What the tokenizer's file says of texts before tokens, where `pieces` holds.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SUFFIX = "</w>"


def parts_as_pieces(described: dict) -> bool:
    """Whether a tokenizer's description has the rules that `pieces` is made for."""
    try:
        split, level = described["pre_tokenizer"]["pretokenizers"]
        return (
            [x["type"] for x in described["normalizer"]["normalizers"]] == _NORMALIZERS
            and (split["type"], split["pattern"], split["behavior"], split["invert"]) == ("Split", {"Regex": _PARTS}, "Removed", True)
            and (level["type"], level["add_prefix_space"], level["use_regex"]) == ("ByteLevel", False, False)
            and (described["model"]["type"], described["model"]["end_of_word_suffix"]) == ("BPE", _SUFFIX)
            and all(x["content"].startswith("<") for x in described.get("added_tokens") or [])
        )
    except (KeyError, TypeError, ValueError):
        return False


class Encoder:
    """ids of texts, by way of their distinct pieces, which a worker remembers; with a vocabulary of other rules, text by text."""

    def __init__(self, path: str | None) -> None:
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY))
        size = self.tokenizer.get_vocab_size()
        self.width = 2 if size <= 1 << 16 else 4
        self.by_pieces = parts_as_pieces(json.loads(self.tokenizer.to_str()))
        #: Each word's last id, and no other, is one of these.
        self.last = np.zeros(size, dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.last[i] = token.endswith(_SUFFIX)
        self._clear()

    def _clear(self) -> None:
        self.index = tk.HashIndex()
        self.ids = np.zeros(0, dtype=np.uint16 if self.width == 2 else np.uint32)
        self.off = np.zeros(1, dtype=np.int64)

    def _encode_new(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the words, and their lengths."""
        lens = ends - starts
        first = np.cumsum(lens + 1) - lens - 1
        text = np.full(int((lens + 1).sum()), 0x20, dtype=np.uint8)
        at = tk.ranges(first, lens)
        got = data[tk.ranges(starts, lens)]
        text[at] = got
        # words of plain letters are one token group each, so many are encoded as one text
        bad = np.concatenate([[0], np.cumsum(~_PLAIN[got])])
        leads, tails = (np.concatenate([[0], np.cumsum(x)]) for x in (got == 0xC3, (got >= 0x80) & (got < 0xC0)))
        end = np.cumsum(lens)
        begin = end - lens
        plain = (bad[end] == bad[begin]) & (leads[end] - leads[begin] == tails[end] - tails[begin])
        raw = text.tobytes()
        spans = list(zip(first.tolist(), (first + lens).tolist(), strict=True))
        found, sizes, begins, n = [], np.zeros(len(lens), dtype=np.int64), np.zeros(len(lens), dtype=np.int64), 0

        def put(idx: np.ndarray, ids: np.ndarray, stops: np.ndarray) -> None:
            nonlocal n
            found.append(ids)
            begins[idx] = n + np.concatenate([[0], stops[:-1]])
            sizes[idx] = np.diff(stops, prepend=0)
            n += len(ids)

        order = np.flatnonzero(plain)
        step = 256
        for a in range(0, len(order), step * 64):
            batch = [order[b : b + step] for b in range(a, min(a + step * 64, len(order)), step)]
            texts = [b" ".join([raw[slice(*spans[i])] for i in idx.tolist()]).decode("utf-8", "replace") for idx in batch]
            for idx, enc in zip(batch, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids = np.array(enc.ids, dtype=np.uint32)
                stops = np.flatnonzero(self.last[ids]) + 1
                if len(stops) == len(idx) and stops[-1] == len(ids):
                    put(idx, ids, stops)
                else:
                    plain[idx] = False
        rest = np.flatnonzero(~plain)
        for a in range(0, len(rest), 4096):
            idx = rest[a : a + 4096]
            words = [raw[slice(*spans[i])].decode("utf-8", "replace") for i in idx.tolist()]
            got_ids = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            put(idx, np.array([i for x in got_ids for i in x], dtype=np.uint32), np.cumsum([len(x) for x in got_ids]))
        flat = np.concatenate([np.zeros(0, np.uint32), *found])
        return flat[tk.ranges(begins, sizes)], sizes

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        flat, lens = self._encode_new(data, starts, ends)
        self.ids = np.concatenate([self.ids, flat.astype(self.ids.dtype)])
        self.off = np.concatenate([self.off, self.off[-1] + np.cumsum(lens)])

    def encode(self, s: tk.Slice, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """ids of all rows, end_id behind each, and the rows' offsets in them."""
        if not self.by_pieces:
            got = self.tokenizer.encode_batch_fast([s.text(i).decode("utf-8", "replace") for i in range(s.n)], add_special_tokens=False)
            rows = [np.array([*x.ids, end_id], dtype=np.uint32) for x in got]
            return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(x) for x in rows])])
        data, starts, ends, rows = pieces(s)
        hashes, first, which = np.unique(tk.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if self.index.n + len(hashes) > CACHE_WORDS:
            self._clear()
        number = self.index.find(hashes)
        new = np.flatnonzero(number < 0)
        if len(new):
            number[new] = self.index.add(hashes[new])
            self._learn(data, starts[first[new]], ends[first[new]])
        word_lens = (self.off[number + 1] - self.off[number])[which]
        flat = self.ids[tk.ranges(self.off[number][which], word_lens)]
        row_lens = np.bincount(rows, weights=word_lens, minlength=s.n).astype(np.int64) + 1
        off = np.concatenate([[0], np.cumsum(row_lens)])
        out = np.full(int(off[-1]), end_id, dtype=np.uint32)
        inner = np.ones(len(out), dtype=bool)
        inner[off[1:] - 1] = False
        out[inner] = flat
        return out, off


@cache
def encoder(path: str | None) -> Encoder:
    # a task has one core; threads of the library's own each keep memory of what they encoded
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path)


def cut(ids: np.ndarray, off: np.ndarray, mean: int = MEAN_CHUNK, largest: int = MAX_CHUNK) -> np.ndarray:
    """Ends of all chunks; each row's end is one."""
    n = len(ids)
    if not n:
        return np.zeros(0, dtype=np.int64)
    v = tk.mix(ids.astype(np.uint64) + np.uint64(1))
    h, power = np.zeros(n, dtype=np.uint64), np.uint64(1)
    for j in range(min(ROLL, n)):
        h[j:] += v[: n - j] * power
        power = np.uint64((int(power) * int(tk._BASE)) & (2**64 - 1))
    ends = np.flatnonzero((tk.mix(h) & np.uint64(mean - 1)) == 0) + 1
    # a window must lie inside its row
    row = np.searchsorted(off, ends - 1, side="right") - 1
    ends = np.union1d(ends[ends - off[row] >= ROLL], off[1:])
    lens = np.diff(ends, prepend=0)
    long = np.flatnonzero(lens > largest)
    if len(long):
        more = [np.arange(ends[i] - lens[i] + largest, ends[i], largest) for i in long]
        ends = np.union1d(ends, np.concatenate(more))
    return ends


def merkle(digests: list[bytes]) -> bytes:
    """Root over leaves in order; a level's odd last node goes up as it is."""
    level = [hashlib.sha256(b"\0" + d).digest() for d in digests] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


class MerkleStream:
    """The same root for leaves that come one by one, holding one node a level."""

    def __init__(self) -> None:
        self.nodes: list[bytes | None] = []
        self.n = 0

    def add(self, digest: bytes) -> None:
        node, level = hashlib.sha256(b"\0" + digest).digest(), 0
        while level < len(self.nodes) and self.nodes[level] is not None:
            node, self.nodes[level] = hashlib.sha256(b"\1" + self.nodes[level] + node).digest(), None
            level += 1
        if level == len(self.nodes):
            self.nodes.append(None)
        self.nodes[level] = node
        self.n += 1

    def root(self) -> bytes:
        if not self.n:
            return hashlib.sha256(b"").digest()
        node = None
        for x in self.nodes:
            if x is not None:
                node = x if node is None else hashlib.sha256(b"\1" + x + node).digest()
        return node


def _crc_tables() -> np.ndarray:
    """[b, j]: what bit j of a crc32 becomes when 2**b zero words of 4 bytes follow."""
    one = np.zeros(32, dtype=np.uint32)  # one zero bit
    one[0] = 0xEDB88320
    one[1:] = np.uint32(1) << np.arange(31, dtype=np.uint32)

    def times(m: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = np.zeros_like(v)
        for j in range(32):
            out ^= np.where((v >> np.uint32(j)) & np.uint32(1), m[j], np.uint32(0))
        return out

    m = one
    for _ in range(5):  # 32 bits
        m = times(m, m)
    tables = [m]
    for _ in range(39):
        tables.append(times(tables[-1], tables[-1]))
    return np.stack(tables)


_CRC = _crc_tables()


def crc_append(crc: np.ndarray, more: np.ndarray, n_ids: np.ndarray) -> np.ndarray:
    """crc32 of A + B from those of A and B, where B has n_ids integers of 4 bytes."""
    crc, n_ids, b = crc.astype(np.uint32), n_ids.copy(), 0
    while n_ids.any():
        odd = (n_ids & 1).astype(bool)
        if odd.any():
            v, out = crc[odd], np.zeros(int(odd.sum()), dtype=np.uint32)
            for j in range(32):
                out ^= np.where((v >> np.uint32(j)) & np.uint32(1), _CRC[b, j], np.uint32(0))
            crc[odd] = out
        n_ids >>= 1
        b += 1
    return crc ^ more.astype(np.uint32)


def _pieces(documents: DataFrame, id_col: str, text_col: str, vocabulary_path: str | None, end_id: int, place: Column) -> DataFrame:
    """Rows of both kinds: chunks (once a task) and recipes; `part` deals them out."""
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), place.cast("long").alias("place"))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sent = encoder(vocabulary_path), set()
        for batch in batches:
            for s in tk.slices(batch.column(1), limit=ENCODE_BYTES):
                ids, off = enc.encode(s, end_id)
                ends = cut(ids, off)
                wide, narrow = ids.astype("<u4").tobytes(), ids.astype(f"<u{enc.width}").tobytes()
                begins = np.concatenate([[0], ends[:-1]])
                w, digests, fresh, payloads = enc.width, [], [], []
                for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
                    d = hashlib.sha256(wide[4 * a : 4 * b]).digest()
                    digests.append(d)
                    if d not in sent:
                        sent.add(d)
                        fresh.append((d, b - a))
                        payloads.append(narrow[w * a : w * b])
                if len(sent) > 1_000_000:
                    sent.clear()
                cuts = np.searchsorted(ends, off[1:]) + 1
                firsts = np.concatenate([[0], cuts[:-1]])
                sizes = ends - begins
                rows = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], cuts]), pa.int32()), pa.array(digests, pa.binary()))
                size_rows = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], cuts]), pa.int32()), pa.array(sizes, pa.int32()))
                doc_ids = batch.column(0).slice(s.rows.start, s.n)
                roots = [merkle(digests[a:b]) for a, b in zip(firsts.tolist(), cuts.tolist(), strict=True)]
                n, m = s.n, len(fresh)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(["recipe"] * n),
                        pa.array([zlib.crc32(str(i).encode()) for i in doc_ids.to_pylist()], pa.int64()),
                        doc_ids,
                        batch.column(2).slice(s.rows.start, s.n),
                        pa.array(np.diff(off), pa.int64()),
                        rows,
                        size_rows,
                        pa.array(roots, pa.binary()),
                        pa.nulls(n, pa.binary()),
                        pa.nulls(n, pa.binary()),
                        pa.nulls(n, pa.int32()),
                    ],
                    names=names,
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(["chunk"] * m),
                        pa.array([int.from_bytes(d[:8], "little", signed=True) for d, _ in fresh], pa.int64()),
                        pa.nulls(m, doc_ids.type),
                        pa.nulls(m, pa.int64()),
                        pa.nulls(m, pa.int64()),
                        pa.nulls(m, rows.type),
                        pa.nulls(m, size_rows.type),
                        pa.nulls(m, pa.binary()),
                        pa.array([d for d, _ in fresh], pa.binary()),
                        pa.array(payloads, pa.binary()),
                        pa.array([k for _, k in fresh], pa.int32()),
                    ],
                    names=names,
                )
        tk.release()

    schema = f"kind string, part long, doc_id {id_type}, place long, n_tokens long, digests array<binary>, sizes array<int>, root binary, digest binary, payload binary, n_ids int"
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    return docs.mapInArrow(run, schema)


def _unique(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of their digest: the first of each, and all without one."""
    last = None
    for batch in batches:
        fresh = []
        for d in batch.column("digest").to_pylist():
            fresh.append(d is None or d != last)
            last = d
        yield batch.filter(pa.array(fresh, pa.bool_()))
    tk.release()


def _merkle_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a task's rows: they are one part, in order."""
    part, tree, tokens = None, MerkleStream(), 0
    for batch in batches:
        for p, root, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if part is not None and p != part:
                yield pa.RecordBatch.from_pydict({"part": [part], "n_docs": [tree.n], "n_tokens": [tokens], "root": [tree.root()]})
                tree, tokens = MerkleStream(), 0
            part = p
            tree.add(root)
            tokens += n
    if part is not None:
        yield pa.RecordBatch.from_pydict({"part": [part], "n_docs": [tree.n], "n_tokens": [tokens], "root": [tree.root()]})


def _blobs(spark: SparkSession, path: str, kind: str, columns: str) -> DataFrame:
    """Rows of one kind; a store without any has no folder of that kind."""
    return spark.read.schema(f"{columns}, kind string").parquet(f"{path}/blobs").filter(F.col("kind") == kind).drop("kind")


CHUNK_COLUMNS = "digest binary, payload binary, n_ids int"
MANIFEST = "part long, n_docs long, n_tokens long, root binary"


def write_store(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str | None = None, end_id: int = END_ID, order_col: str | None = None) -> None:
    """Encode documents and write the store to a folder that all executors share. order_col: a long column by which
    documents stand in it, before their ids."""
    spark = documents.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = _pieces(documents, id_col, text_col, vocabulary_path, end_id, F.col(order_col) if order_col else F.lit(None)).repartition(n, "part")
    # equal chunks stand side by side after a sort that spills, so no task holds a set of its digests
    unique = pieces.sortWithinPartitions("digest").mapInArrow(_unique, pieces.schema)
    unique.write.mode("overwrite").option("compression", "zstd").partitionBy("kind").parquet(f"{path}/blobs")
    id_type = pieces.schema["doc_id"].dataType.simpleString()
    recipes = _blobs(spark, path, "recipe", f"doc_id {id_type}, place long, n_tokens long, digests array<binary>, sizes array<int>, root binary")
    # dealt by root too, as an id alone may be in many rows
    order = ["place", "doc_id", "root"] if order_col else ["doc_id", "root"]
    sorted_rows = recipes.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    sorted_rows.write.mode("overwrite").parquet(f"{path}/sorted")
    placed = spark.read.parquet(f"{path}/sorted")
    totals = placed.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    starts = totals.select(F.col("part").alias("p"), F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    offset = placed.withColumn("before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(starts, F.col("part") == F.col("p"))
    final = offset.select("part", "doc_id", (F.col("part_start") + F.col("before")).alias("start"), "n_tokens", "digests", "sizes", "root")
    final.repartitionByRange(n, "part").sortWithinPartitions("part", "start").write.mode("overwrite").parquet(f"{path}/recipes")
    parts = spark.read.parquet(f"{path}/recipes").select("part", "root", "n_tokens", "start").repartition(n, "part").sortWithinPartitions("part", "start").drop("start")
    made = parts.mapInArrow(_merkle_parts, MANIFEST).collect()  # one row a part
    rows = sorted((r.part, r.n_docs, r.n_tokens, bytes(r.root)) for r in made)
    whole = (-1, sum(r[1] for r in rows), sum(r[2] for r in rows), merkle([r[3] for r in rows]))
    spark.createDataFrame([*rows, whole], MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """digest, crc (unsigned crc32 of the ids as 4-byte integers), n_ids; a chunk that isn't what its address says is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = []
            for d, payload, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                wide = np.frombuffer(payload, dtype=f"<u{len(payload) // n}").astype("<u4").tobytes()
                if hashlib.sha256(wide).digest() != d:
                    raise ValueError(f"chunk {d.hex()} is damaged")
                crcs.append(zlib.crc32(wide))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crcs, pa.int64()), batch.column(2)], names=["digest", "crc", "n_ids"])

    return _blobs(spark, path, "chunk", CHUNK_COLUMNS).mapInArrow(run, "digest binary, crc long, n_ids int")


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the crc32s of each row's chunks, and compares sizes and root with the recipe."""
    for batch in batches:
        cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        chunks = cols["chunks"]
        counts = np.diff(np.asarray(chunks.offsets)).astype(np.int64)
        flat = chunks.flatten()
        at = np.concatenate([[0], np.cumsum(counts)])
        crcs, sizes = flat.field("crc").to_numpy(zero_copy_only=False), flat.field("n_ids").to_numpy(zero_copy_only=False).astype(np.int64)
        digests = flat.field("digest").to_pylist()
        crc = np.zeros(len(counts), dtype=np.uint32)
        for j in range(int(counts.max()) if len(counts) else 0):
            live = np.flatnonzero(counts > j)
            crc[live] = crc_append(crc[live], crcs[at[live] + j], sizes[at[live] + j])
        total = np.concatenate([[0], np.cumsum(sizes)])
        fine = [merkle(digests[a:b]) == bytes(r) for a, b, r in zip(at[:-1].tolist(), at[1:].tolist(), cols["root"].to_pylist(), strict=True)]
        n_tokens = total[at[1:]] - total[at[:-1]]
        yield pa.RecordBatch.from_arrays(
            [cols["doc_id"], cols["start"], pa.array(n_tokens, pa.int64()), pa.array(crc.astype(np.int64), pa.int64()), pa.array(fine & (n_tokens == cols["n_tokens"].to_numpy()), pa.bool_())],
            names=["doc_id", "start", "n_tokens", "ids_crc32", "verified"],
        )


def document_summaries(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, verified for each document, from the store's files. Payloads are read where
    they lie: a document's crc32 is made of its chunks', so only those travel."""
    recipes = spark.read.parquet(f"{path}/recipes")
    refs = recipes.select("start", F.posexplode("digests").alias("pos", "digest"))
    # a chunk of many documents is one row on its side, so Spark can split the other
    known = refs.join(read_chunks(spark, path), "digest")
    grouped = known.groupBy("start").agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "crc", "n_ids"))).alias("chunks"))
    # start is unique, as each document has an end id at least
    rows = recipes.select("doc_id", "start", "n_tokens", "root").join(grouped, "start", "left")
    id_type = recipes.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "start", "n_tokens", "root", "chunks").mapInArrow(_summaries, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long, verified boolean")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids array<int>: the documents put together again."""

    def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for chunks in batch.column(2).to_pylist():
                out.append(np.concatenate([np.frombuffer(c["payload"], dtype=f"<u{len(c['payload']) // c['n_ids']}") for c in chunks]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])

    recipes = spark.read.parquet(f"{path}/recipes")
    chunks = _blobs(spark, path, "chunk", CHUNK_COLUMNS)
    refs = recipes.select("start", F.posexplode("digests").alias("pos", "digest")).join(chunks, "digest")
    grouped = refs.groupBy("start").agg(F.array_sort(F.collect_list(F.struct("pos", "payload", "n_ids"))).alias("chunks"))
    rows = recipes.select("doc_id", "start").join(grouped, "start").select("doc_id", "start", "chunks")
    return rows.mapInArrow(join_ids, f"doc_id {recipes.schema['doc_id'].dataType.simpleString()}, start long, ids array<int>")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/manifest")


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-store")
    write_store(table(spark, sf_dir, "documents"), path)
    return document_summaries(spark, path)
