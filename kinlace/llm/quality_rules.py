"""Quality rules: word statistics and zstandard compression bands.

Every text is compressed as a whole and in fixed chunks. A ratio is compressed bytes / bytes: a low one
tells of repetition, a high one of noise. The limits depend on the length, as short texts compress
less. A text is rejected if the whole's ratio is out of its band, or if more than `bad_share` of its
chunk bytes are in chunks out of the chunk band.

Defined cases: a null text is an empty text; a text without bytes has ratio 1 and is judged by the base
rule alone; lines and word windows are compared by 64-bit hashes of their exact bytes; equal rows get
equal results; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kinlace.llm import textkit as tk
from kinlace.llm.tables import annotate, filtered, table


#: Text that is looked at together: the arrays of word statistics take some 60 bytes a byte of it.
SLICE_BYTES = 512 << 10


@dataclass(frozen=True)
class Bands:
    """(least bytes, lowest ratio, highest ratio), by rising least bytes; the last that fits holds."""

    whole: tuple[tuple[int, float, float], ...] = ((0, 0.0, 9.0), (200, 0.20, 0.90), (1_000, 0.15, 0.75), (4_000, 0.12, 0.70), (20_000, 0.10, 0.70))
    chunk: tuple[tuple[int, float, float], ...] = ((0, 0.0, 9.0), (512, 0.15, 0.80), (4_096, 0.12, 0.75))
    chunk_bytes: int = 4_096
    bad_share: float = 0.5
    level: int = 3

    @staticmethod
    def inside(bands: tuple[tuple[int, float, float], ...], size: np.ndarray, ratio: np.ndarray) -> np.ndarray:
        at = np.searchsorted([b[0] for b in bands], size, side="right") - 1
        return (ratio >= np.array([b[1] for b in bands])[at]) & (ratio <= np.array([b[2] for b in bands])[at])


#: The lowest ratios, close under those of texts with labels.quality = 1 in the test tables (level 3): texts of that
#: kind of prose. Another corpus, or another level, needs limits of its own; the defaults of Bands are wide ones.
_CLEAN = (
    (200, 0.59), (300, 0.51), (400, 0.52), (600, 0.51), (800, 0.493), (1_000, 0.483), (1_300, 0.475), (1_600, 0.458), (2_000, 0.455), (2_500, 0.450), (3_000, 0.445),
    (4_000, 0.434), (5_000, 0.432), (6_000, 0.423), (8_000, 0.418), (10_000, 0.412), (14_000, 0.405), (20_000, 0.398), (30_000, 0.390), (60_000, 0.370), (200_000, 0.30),
)
CLEAN_BANDS = Bands(whole=((0, 0.0, 9.0), *((n, low, 0.90 if n < 1_000 else 0.75 if n < 4_000 else 0.70) for n, low in _CLEAN)))

_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "whole_ratio double, bad_chunk_share double, kept boolean"
)
_TYPES = [(x.split()[0], {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[x.split()[1]]) for x in SCHEMA.split(", ")]


def word_statistics(s: tk.Slice) -> dict[str, np.ndarray]:
    starts, ends, rows = s.words(tk.SPACE_WORDS)
    n_words = np.bincount(rows, minlength=s.n)
    # code points are bytes that don't continue one
    word_chars = s.count(tk.SPACE_WORDS[s.data] & ((s.data & 0xC0) != 0x80))
    hashes = tk.span_hashes(s.data, starts, ends)
    grams = tk.gram_hashes(hashes, 3)
    repeat = np.zeros(len(hashes), dtype=bool)
    if len(grams):
        whole = np.flatnonzero(rows[: len(grams)] == rows[2:])
        _, times = tk.distinct_counts(tk.by_row(grams[whole], rows[whole]))
        twice = whole[times > 1]
        for j in range(3):
            repeat[twice + j] = True
    # lines with a word: their bounds are \n or the text's ends
    newline = np.flatnonzero(s.data == 10)
    line_starts = np.unique(np.concatenate([s.off[:-1], newline + 1]))
    line_starts = line_starts[line_starts < len(s.data)]
    stops = np.append(newline, len(s.data))
    line_ends = np.minimum(stops[np.searchsorted(newline, line_starts)], s.off[s.row_of(line_starts) + 1])
    full = line_ends > line_starts
    line_starts, line_ends = line_starts[full], line_ends[full]
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[worded], line_ends[worded]
    line_rows = s.row_of(line_starts)
    again, _ = tk.distinct_counts(tk.by_row(tk.span_hashes(s.data, line_starts, line_ends), line_rows))
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": s.count(_SYMBOLS[s.data]),
        "n_dup_lines": np.bincount(line_rows[again], minlength=s.n),
        "n_repeat_words": np.bincount(rows[repeat], minlength=s.n),
    }


def compression(s: tk.Slice, bands: Bands) -> dict[str, np.ndarray]:
    import zstandard

    pack = zstandard.ZstdCompressor(level=bands.level, write_content_size=False, write_checksum=False).compress
    size = np.diff(s.off)
    whole, share = np.ones(s.n), np.zeros(s.n)
    for i in range(s.n):
        text = s.text(i)
        if not text:
            continue
        whole[i] = len(pack(text)) / len(text)
        if len(text) > bands.chunk_bytes:
            chunks = [text[a : a + bands.chunk_bytes] for a in range(0, len(text), bands.chunk_bytes)]
            lens = np.array([len(c) for c in chunks])
            good = Bands.inside(bands.chunk, lens, np.array([len(pack(c)) for c in chunks]) / lens)
            share[i] = lens[~good].sum() / lens.sum()
        else:
            share[i] = float(not Bands.inside(bands.chunk, size[i : i + 1], whole[i : i + 1])[0])
    fine = Bands.inside(bands.whole, size, whole) & (share <= bands.bad_share)
    return {"whole_ratio": whole, "bad_chunk_share": share, "fine": fine}


def judge(texts: pa.Array, bands: Bands) -> dict[str, np.ndarray]:
    parts = []
    for s in tk.slices(texts, limit=SLICE_BYTES):
        x = word_statistics(s)
        x["base_failed"] = (x["n_words"] < 50) | (100 * x["n_repeat_words"] > 50 * x["n_words"])
        x |= compression(s, bands)
        x["kept"] = ~x["base_failed"] & x.pop("fine")
        parts.append(x)
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k, _ in _TYPES}


def quality_report(documents: DataFrame, bands: Bands | None = None, text_col: str = "text") -> DataFrame:
    """All columns of documents and those of SCHEMA, without a shuffle."""
    bands = bands or Bands()

    def work(texts: pa.Array) -> list[pa.Array]:
        x = judge(texts, bands)
        return [pa.array(x[k], type=t) for k, t in _TYPES]

    return annotate(documents, text_col, work, SCHEMA)


def quality_filter(documents: DataFrame, bands: Bands | None = None, text_col: str = "text") -> DataFrame:
    """The rows of documents that are kept, with their own columns only."""
    bands = bands or Bands()
    return filtered(documents, text_col, lambda texts: judge(texts, bands)["kept"].astype(bool))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents").select("doc_id", "text"), CLEAN_BANDS).drop("text")
