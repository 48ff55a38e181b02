from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from albumflow.llm import kernels as k
from albumflow.llm.components import forest, stars

TEXTS = st.lists(st.one_of(st.none(), st.text(st.sampled_from("aB \t\n\u0085 é\x1c."), max_size=30)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 40))
def test_words(texts, size):
    got = [None] * len(texts)
    for part in k.text_slices(pa.array(texts, pa.string()), size):
        words = k.split_words(part)
        for i in range(part.count):
            got[part.first + i] = [part.data[words.start[j] : words.end[j]].tobytes() for j in range(words.bounds[i], words.bounds[i + 1])]
    assert got == [re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode()) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abAB", min_size=1, max_size=5), min_size=1, max_size=30))
def test_equal_hashes_for_equal_words(words):
    (part,) = k.text_slices(pa.array([" ".join(words)]))
    for fold in (True, False):
        own = [w.lower() if fold else w for w in words]
        hashes = k.word_hashes(part, k.split_words(part), fold)
        assert len(set(zip(own, hashes.tolist(), strict=True))) == len(set(own)) == len(set(hashes.tolist()))


def thue_morse(n, a="a", b="b"):
    """Of n bits: where a letter stands, the parity of its place's ones decides."""
    return "".join(b if i.bit_count() % 2 else a for i in range(1 << n))


def test_siphash_of_the_published_example(monkeypatch):
    key = np.array([0x0706050403020100, 0x0F0E0D0C0B0A0908] * 2, dtype=np.uint64)
    plain = np.array([int.from_bytes(b"somepseudorandomlygeneratedbytes"[i : i + 8], "big") for i in range(0, 32, 8)], dtype=np.uint64)
    monkeypatch.setattr(k, "_START", key ^ plain)
    data = np.arange(23, dtype=np.uint8)
    eight = np.ndarray(16, "<u8", data, strides=(1,))
    assert int(k._siphash(eight, np.array([0]), np.array([15]))[0]) == 0xA129CA6149BE45E5


@pytest.mark.parametrize("n", [3, 5, 10])
def test_words_of_one_structure_do_not_meet(n):
    words = [thue_morse(n), thue_morse(n, "b", "a")]
    (part,) = k.text_slices(pa.array([" ".join(words)]))
    assert len(set(k.word_hashes(part, k.split_words(part), False).tolist())) == 2
    several = np.array([3, 5], dtype=np.uint64)
    one, other = (k.shingle_hashes(several[[i.bit_count() % 2 ^ flip for i in range(1 << n)]], 1 << n) for flip in (0, 1))
    assert one != other


@settings(max_examples=80, deadline=None)
@given(TEXTS, st.integers(1, 40))
def test_joined_words(texts, size):
    for part in k.text_slices(pa.array(texts, pa.string()), size):
        words = k.split_words(part)
        data, start, end = k.joined_words(part, words)
        own = [part.data[a:b].tobytes() for a, b in zip(words.start, words.end, strict=True)]
        assert data.tobytes() == b"".join(w + b" " for w in own)
        assert [data[a:b].tobytes() for a, b in zip(start, end, strict=True)] == own


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab", max_size=40), min_size=1, max_size=5), st.integers(3, 9), st.integers(1, 3))
def test_segments_cover_all_windows_once(texts, window, gram):
    (part, *rest) = list(k.text_slices(pa.array(texts)))
    if rest or not len(part.data):
        return
    values = k.RunningHash(k.BYTE_VALUES[part.data])
    s = k.window_segments(values, part.bounds, window, gram)
    seen, by_content = set(), {}
    for row, start, count, anchor, key in zip(*(x.tolist() for x in s), strict=True):
        for i in range(count):
            seen.add((row, start + i))
            piece = texts[row][start + i : start + i + window]
            assert by_content.setdefault(piece, (key, anchor - i)) == (key, anchor - i)
    assert seen == {(r, i) for r, t in enumerate(texts) for i in range(len(t) - window + 1)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 15), st.integers(0, 15)), max_size=30))
def test_forest(links):
    a, b = (np.array(x, dtype=np.int64) for x in (zip(*links, strict=True) if links else ((), ())))
    root = list(range(16))
    for _ in range(16):
        for x, y in links:
            root[x] = root[y] = min(root[x], root[y])
    assert forest(16, a, b).tolist() == root
    node, low = stars(a, b)
    assert dict(zip(node.tolist(), low.tolist(), strict=True)) == {i: r for i, r in enumerate(root) if r != i}
