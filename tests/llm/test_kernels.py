import re
import tracemalloc

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from metaframe.llm import kernels
from metaframe.llm.components import local_forest
from metaframe.llm.kernels import NOT_ALNUM, Texts, shingles, unique_within

TEXTS = st.lists(st.one_of(st.none(), st.text("aB é\t\n.1%\x1c", max_size=30)), max_size=8)


def lower(x):
    return x.translate({c: c + 32 for c in range(65, 91)})


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words(texts):
    for separators, pattern in ((None, r"[^\x20\x09-\x0D]+"), (NOT_ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = Texts(pa.array(texts, pa.string())).words(*([] if separators is None else [separators]))
        got = [w.data[s:e].tobytes().decode() for s, e in zip(w.starts, w.ends, strict=True)]
        expected = [re.findall(pattern, lower(t or "")) for t in texts]
        assert got == [x for e in expected for x in e]
        assert np.diff(w.first).tolist() == [len(e) for e in expected]
        h = w.hashes()
        assert len({(int(a), b) for a, b in zip(h, got, strict=True)}) == len(set(got)) == len(np.unique(h))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=7), max_size=6), st.integers(1, 4))
def test_shingles(docs, k):
    w = Texts(pa.array([" ".join(d) for d in docs], pa.string())).words()
    values, bounds = unique_within(*shingles(w.hashes(), w.first, k))
    expected = [{tuple(d[i : i + k]) for i in range(max(1, len(d) - k + 1))} if d else set() for d in docs]
    assert np.diff(bounds).tolist() == [len(e) for e in expected]
    for i, a in enumerate(expected):
        for j, b in enumerate(expected):
            assert len(np.intersect1d(values[bounds[i] : bounds[i + 1]], values[bounds[j] : bounds[j + 1]])) == len(a & b)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=1, max_size=20))
def test_local_forest(edges):
    a, b = (np.array(x) for x in zip(*edges, strict=True))
    child, root = local_forest(a, b)
    label = dict(zip(child.tolist(), root.tolist(), strict=True))
    parts = [{x} for x in range(13)]
    for u, v in edges:
        pu, pv = next(p for p in parts if u in p), next(p for p in parts if v in p)
        if pu is not pv:
            parts.remove(pv)
            pu |= pv
    assert all(label.get(x, x) == min(next(p for p in parts if x in p)) for x in range(13))


def test_a_very_long_word_needs_memory_in_proportion():
    """A word of 64 MB: no table grows with it, and words of the same start or end differ."""
    size = 64 << 20
    column = pa.array(["x" * size + " tail", "x" * (size - 1) + "y"])
    tracemalloc.start()
    w = Texts(column).words()
    hashes = w.hashes()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.diff(w.first).tolist() == [2, 1] and len(np.unique(hashes)) == 3
    assert peak < 14 * 2 * size and len(kernels._POWERS) < 1 << 20


def test_words_that_collide_as_sums_of_powers_differ():
    """Thue-Morse words of 1,024 letters and their complements have one polynomial hash modulo 2**64 in any odd base."""
    bits = [0]
    while len(bits) < 4096:
        bits += [1 - b for b in bits]
    for n in (64, 128, 255, 256, 1024, 4096):
        pair = ["".join("ab"[b ^ flip] for b in bits[:n]) for flip in (0, 1)]
        assert len(np.unique(Texts(pa.array(pair)).words().hashes())) == 2


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 400), st.integers(0, 600)), max_size=8))
def test_span_hashes_depend_on_the_span_alone(spans):
    data = np.frombuffer(np.random.default_rng(1).bytes(1200), dtype=np.uint8)
    data = np.concatenate([data, data])
    spans.sort()
    starts, ends = (np.array([s for s, _ in spans], dtype=np.int64), np.array([s + n for s, n in spans], dtype=np.int64))
    for table in (kernels.BYTE_VALUES, None):
        a = kernels.span_hashes(data, starts, ends, table)
        assert (a == kernels.span_hashes(data, starts + 1200, ends + 1200, table)).all()
        assert [len({bytes(data[s:e]) for s, e in zip(starts, ends, strict=True)})] == [len(np.unique(a))]
