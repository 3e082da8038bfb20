import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from kinlace.llm import textkit as tk

TEXT = st.lists(st.one_of(st.none(), st.text(st.sampled_from("aB9é漢 \n\t.-"), max_size=20)), max_size=6)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(1, 30))
def test_words(texts, limit):
    for table, pattern, lower in ((tk.SPACE_WORDS, "[^\x20\x09-\x0d]+", False), (tk.ALNUM_WORDS, "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", True)):
        got = [[] for _ in texts]
        for s in tk.slices(pa.array(texts, pa.string()), lower=lower, limit=limit):
            starts, ends, rows = s.words(table)
            for a, b, r in zip(starts, ends, rows, strict=True):
                got[s.rows.start + r].append(s.data[a:b].tobytes().decode())
        fold = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t) if lower else t  # noqa: B023, E731
        assert got == [re.findall(pattern, fold(t or "")) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=6), min_size=1, max_size=30))
def test_hashes_tell_spans_apart(spans):
    data = np.frombuffer(b"".join(spans), np.uint8)
    ends = np.cumsum([len(s) for s in spans])
    h = tk.span_hashes(data, np.concatenate([[0], ends[:-1]]), ends)
    for x, a in zip(spans, h, strict=True):
        for y, b in zip(spans, h, strict=True):
            assert (x == y) == (a == b)


def test_key_filter():
    keys = np.random.default_rng(1).integers(-(2**62), 2**62, 5_000)
    f = tk.KeyFilter()
    f.add(keys)
    assert f.has(keys).all() and f.has(keys + 1).mean() < 0.01


def test_hash_index():
    index, rng = tk.HashIndex(), np.random.default_rng(2)
    seen = {}
    for _ in range(30):
        keys = np.unique(rng.integers(0, 100_000, 4_000).astype(np.uint64))
        number = index.find(keys)
        assert all((seen.get(k, -1)) == n for k, n in zip(keys.tolist(), number.tolist(), strict=True))
        new = keys[number < 0]
        seen.update(zip(new.tolist(), index.add(new).tolist(), strict=True))


def test_sliced_and_null_columns():
    column = pa.array(["a b", None, "c", ""])[1:]
    assert [s.text(i) for s in tk.slices(column) for i in range(s.n)] == [b"", b"c", b""]
    assert list(tk.slices(pa.array([], pa.string()))) == []
