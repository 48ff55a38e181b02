"""Vectorised numpy kernels over Arrow text batches, shared by the corpus operators.

Spark does the partitioning and shuffling; inside a task these helpers turn a batch of
texts into flat arrays of words and hashes.  Texts are handled in slices of about
``SLICE_BYTES`` so that temporary arrays stay small whatever the batch size; one text
is never cut.  A null text counts as an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

U64 = np.uint64
_GOLDEN = U64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + _GOLDEN
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Everything but digits, A-Z, a-z and bytes of characters outside ASCII.
MARKS = np.ones(256, dtype=bool)
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    MARKS[_low:_high] = False
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
BYTE_VALUES = mix64(np.arange(1, 257, dtype=U64))
BYTE_VALUES_FOLDED = BYTE_VALUES[_FOLD]

_powers = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the hash base and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for i, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, dtype=U64)
            table[0] = 1
            _powers[i] = np.multiply.accumulate(table)
    return _powers[0][:n], _powers[1][:n]


class RunningHash:
    """Position-independent hashes of any slice of a sequence of 64-bit values.

    A polynomial modulo 2**64, which repetitive input can defeat: unequal slices may have
    equal hashes.  So it only picks minimisers and brings candidates together; whether they
    are equal is decided by ``word_hashes``, ``shingle_hashes`` and ``digests``.
    """

    def __init__(self, values: np.ndarray):
        power, self._inverse = _power_tables(len(values) + 1)
        self._sums = np.zeros(len(values) + 1, dtype=U64)
        np.cumsum(values * power[:-1], out=self._sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self._sums[end] - self._sums[start]) * self._inverse[start]
        return mix64(raw + (np.asarray(end) - np.asarray(start)).astype(U64) * _GOLDEN)

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all slices of length k (an empty array if the sequence is shorter)."""
        n = len(self._sums) - k
        if n <= 0:
            return np.zeros(0, dtype=U64)
        return mix64((self._sums[k:] - self._sums[:n]) * self._inverse[:n])


class Texts(NamedTuple):
    """Rows first..first+count of a batch; text i is data[bounds[i]:bounds[i + 1]]."""

    first: int
    count: int
    data: np.ndarray
    bounds: np.ndarray


def text_slices(texts: pa.Array | pa.ChunkedArray, size: int = SLICE_BYTES) -> Iterator[Texts]:
    """Whole texts of a string column, in slices of about ``size`` bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):  # no chunk at all
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if len(texts) == 0:
        return
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(bounds, bounds[at] + size, side="right")) - 1
        to = min(max(to, at + 1), len(texts))
        yield Texts(at, to - at, data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at])
        at = to
    pa.default_memory_pool().release_unused()  # the worker stays; its freed buffers need not


class Words(NamedTuple):
    """Words of a slice: byte ranges, and the word range bounds[i]:bounds[i + 1] of text i."""

    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray


def split_words(texts: Texts, separators: np.ndarray = _SPACE) -> Words:
    """Words of every text of a slice; by default ``[^\\x20\\x09-\\x0D]+``."""
    data, bounds = texts.data, texts.bounds
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return Words(none, none, np.zeros(texts.count + 1, dtype=np.int64))
    space = separators[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[1:-1] = space[1:] != space[:-1]
    edge[bounds] = True
    edges = np.flatnonzero(edge)
    inside = np.flatnonzero(~space[edges[:-1]])
    start, end = edges[inside], edges[inside + 1]
    return Words(start, end, np.searchsorted(start, bounds))


# SipHash-2-4 with a fixed key.
_START = np.array([0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573], dtype=U64) ^ np.array([0x0123456789ABCDEF, 0xFEDCBA9876543210] * 2, dtype=U64)
_TAIL = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], dtype=U64)
LONG_WORD = 64  # longer words are hashed one by one
_WORDS_AT_ONCE = 1 << 13


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << U64(by)) | (x >> U64(64 - by))


def _rounds(state: list[np.ndarray], times: int) -> list[np.ndarray]:
    a, b, c, d = state
    for _ in range(times):
        a, c = a + b, c + d
        b, d = _turn(b, 13) ^ a, _turn(d, 16) ^ c
        a, c = _turn(a, 32) + d, c + b
        b, d = _turn(b, 17) ^ c, _turn(d, 21) ^ a
        c = _turn(c, 32)
    return [a, b, c, d]


def _siphash(eight: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges of ``size`` from ``start``; ``eight[i]`` is the eight bytes from i."""
    state = [np.full(len(start), x) for x in _START]
    pieces = size // 8 + 1
    for n in range(int(pieces.max(initial=0))):
        at = np.flatnonzero(pieces > n)
        left = np.minimum(size[at] - 8 * n, 8)
        piece = (eight[start[at] + 8 * n] & _TAIL[left]) | np.where(left < 8, size[at].astype(U64) << U64(56), U64(0))
        a, b, c, d = (x[at] for x in state)
        a, b, c, d = _rounds([a, b, c, d ^ piece], 2)
        for x, new in zip(state, (a ^ piece, b, c, d), strict=True):
            x[at] = new
    a, b, c, d = state
    a, b, c, d = _rounds([a, b, c ^ U64(0xFF), d], 4)
    return a ^ b ^ c ^ d


def word_hashes(texts: Texts, words: Words, fold: bool) -> np.ndarray:
    """A 64-bit hash of each word's bytes; ``fold`` lower-cases A-Z first.

    SipHash, or the start of BLAKE2b for words over ``LONG_WORD`` bytes, so words that are alike
    in structure do not meet.
    """
    data = np.append(_FOLD[texts.data] if fold else texts.data, np.zeros(8, np.uint8))
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    size = words.end - words.start
    out = np.empty(len(size), dtype=U64)
    for at in range(0, len(size), _WORDS_AT_ONCE):
        part = slice(at, at + _WORDS_AT_ONCE)
        out[part] = _siphash(eight, words.start[part], np.minimum(size[part], LONG_WORD))
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = np.frombuffer(hashlib.blake2b(data[words.start[i] : words.end[i]]).digest(), U64)[0]
    return out


def joined_words(texts: Texts, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all words one space apart, and each word's range in them."""
    start = np.cumsum(np.append(0, words.end - words.start + 1))
    out = np.full(start[-1], 0x20, dtype=np.uint8)
    inside = np.zeros(len(texts.data) + 1, dtype=np.int8)
    inside[words.start] = 1
    inside[words.end] -= 1
    filled = np.zeros(len(out) + 1, dtype=np.int8)
    filled[start[:-1]] = 1
    filled[start[1:] - 1] -= 1
    out[np.cumsum(filled[:-1], dtype=np.int8).view(bool)] = texts.data[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
    return out, start[:-1], start[1:] - 1


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each ``size`` consecutive word hashes, mixed one after the other."""
    n = max(0, len(words) - size + 1)
    out = np.full(n, size, dtype=U64)
    for i in range(size):
        out = mix64(out ^ words[i : i + n])
    return out


def digests(pieces: Iterable) -> np.ndarray:
    """128 bits of each piece's BLAKE2b, as two bigints a row."""
    joined = b"".join([hashlib.blake2b(x).digest()[:16] for x in pieces])
    return np.frombuffer(joined, np.int64).reshape(-1, 2)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    if len(values) < width:
        return values[:0]
    out, span = values, 1
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


class Segments(NamedTuple):
    """Runs of consecutive windows that have the same minimiser place."""

    row: np.ndarray  # text within the slice
    start: np.ndarray  # first window, counted from the start of the text
    windows: np.ndarray  # number of windows
    anchor: np.ndarray  # symbols from the first window's start to the minimiser
    key: np.ndarray  # hash of the minimiser


def window_segments(values: RunningHash, bounds: np.ndarray, window: int, gram: int) -> Segments:
    """Group the windows of ``window`` symbols of each text by their minimiser.

    The minimiser of a window is its gram of ``gram`` symbols with the smallest hash, the
    leftmost of equals.  It depends on the window's content alone: equal windows have
    equal keys, and their minimiser at the same place.  A run has at most
    ``window - gram + 1`` windows.  bounds[i]:bounds[i + 1] are the symbols of text i.
    """
    grams = values.grams(gram)
    low = U64(max(1, len(grams)).bit_length())
    least = sliding_min((grams >> low << low) | np.arange(len(grams), dtype=U64), window - gram + 1)
    lengths = np.maximum(np.diff(bounds) - window + 1, 0)
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = bounds[row] + place
    least = least[at]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(row)))
    begin = at[first]
    chosen = (least[first] & ((U64(1) << low) - U64(1))).astype(np.int64)
    return Segments(row[first], place[first], size, chosen - begin, grams[chosen])


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's bigint."""
    return x.view(np.int64)


def table(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
