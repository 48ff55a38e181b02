"""Windows of a corpus as anchored segments: the fingerprints of both substring operators.

A window is a fixed number of consecutive symbols (words or bytes).  Neighbouring
windows with the same minimiser form a segment (see ``kernels.window_segments``), so an
index holds about one row for every twenty words instead of one a window.  Segments are
equal if their contents' digests (128 bits of BLAKE2b, columns ``digest`` and ``more``) are;
equal segments have equal windows, and windows of unequal segments can only be equal if the
keys are.  A key is a quick hash and decides nothing by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumflow.llm import bloom
from albumflow.llm.kernels import BYTE_VALUES, U64, RunningHash, Segments, Texts, digests, joined_words, mix64, signed, split_words, text_slices, window_segments, word_hashes
from albumflow.llm.shared import arrow_schema

CLASS = ["key", "digest", "more", "windows"]


class Symbols(NamedTuple):
    """The symbols of a slice of texts: hashes, the symbol range of each text, and their bytes."""

    hashes: RunningHash
    bounds: np.ndarray
    data: memoryview
    start: np.ndarray | None  # bytes of each symbol; none where symbols are bytes
    end: np.ndarray | None

    def pieces(self, first: np.ndarray, count: np.ndarray) -> list[memoryview]:
        """The bytes of ``count`` symbols from each of ``first``; words are one space apart."""
        low, high = first, first + count
        if self.start is not None:
            low, high = self.start[first], self.end[first + count - 1]
        return [self.data[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)]


class Kind(NamedTuple):
    """What a symbol is, and the sizes of windows and grams."""

    words: bool
    window: int
    gram: int

    def symbols(self, texts: Texts) -> Symbols:
        if not self.words:
            return Symbols(RunningHash(BYTE_VALUES[texts.data]), texts.bounds, memoryview(texts.data), None, None)
        words = split_words(texts)
        data, start, end = joined_words(texts, words)
        return Symbols(RunningHash(word_hashes(texts, words, fold=False)), words.bounds, memoryview(data), start, end)


LONG_PART = 4 << 20


def _parts(texts: Texts, kind: Kind) -> Iterator[tuple[Texts, int]]:
    """A slice as it is, or a very long text of bytes in parts that share no window; each part's place.

    Segments end where parts do, so equal text may lie in unequal segments; those have
    one key, and their windows are compared one by one.
    """
    if kind.words or texts.count > 1 or len(texts.data) <= 2 * LONG_PART:
        yield texts, 0
        return
    for at in range(0, len(texts.data) - kind.window + 1, LONG_PART):
        data = texts.data[at : at + LONG_PART + kind.window - 1]
        yield Texts(texts.first, 1, data, np.array([0, len(data)])), at


def scan(kind: Kind, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, Symbols, Segments, int]]:
    """Ids (nulls left out), symbols, segments, and place of the symbols, of each slice of (doc_id, text)."""
    batch = batch.filter(batch.column(0).is_valid())
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    for whole in text_slices(batch.column(1)):
        for texts, place in _parts(whole, kind):
            symbols = kind.symbols(texts)
            found = window_segments(symbols.hashes, symbols.bounds, kind.window, kind.gram)
            yield ids[texts.first : texts.first + texts.count], symbols, found, place


def _class(kind: Kind, symbols: Symbols, s: Segments) -> list[pa.Array]:
    """The columns of CLASS."""
    own = digests(symbols.pieces(symbols.bounds[s.row] + s.start, s.windows + kind.window - 1))
    return [pa.array(signed(s.key)), pa.array(own[:, 0]), pa.array(own[:, 1]), pa.array(s.windows.astype(np.int32))]


def classes(docs: DataFrame, kind: Kind) -> DataFrame:
    """One row for each distinct segment: CLASS, first (smallest doc_id), times."""
    ddl = "key bigint, digest bigint, more bigint, windows int, doc_id bigint"
    schema = arrow_schema(ddl)

    def rows(batches):
        for batch in batches:
            for ids, symbols, s, _ in scan(kind, batch):
                yield pa.RecordBatch.from_arrays([*_class(kind, symbols, s), pa.array(ids[s.row])], schema=schema)

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, ddl)
    return found.groupBy(*CLASS).agg(F.min("doc_id").alias("first"), F.count("*").alias("times"))


def repeated_keys(merged: DataFrame) -> DataFrame:
    """Keys of which a window may stand in two places: key, kinds (distinct segments), times."""
    keys = merged.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("times").alias("times"))
    return keys.where("kinds > 1 or times > 1")


def key_filter(keys: DataFrame):
    """Places of all the keys, and a Bloom filter of the keys and of the complements of those with several segments; broadcast."""
    every, several, places = keys.agg(F.count("*"), F.count_if(F.col("kinds") > 1), F.sum("times")).first()
    entries = F.when(F.col("kinds") > 1, F.array("key", F.bitwise_not("key"))).otherwise(F.array("key"))
    built = bloom.build(keys.select(F.explode(entries).alias("key")), every + several)
    return places or 0, keys.sparkSession.sparkContext.broadcast(built)


def occurrences(docs: DataFrame, kind: Kind, known, name: str, ddl: str, detail: Callable, only_several: bool = False, popular=None, documents=None, counter: Accumulator | None = None) -> DataFrame:
    """Second scan: the segments whose key is in the filter ``known``; those that are ``popular`` have a ``salt``.

    With a filter of ``documents`` all texts but theirs are passed over; ``counter`` counts those that are not.

    ``detail(symbols, segments)`` gives a value for each segment whose key has several
    segments (column ``name`` of type ``ddl``; null for the others).
    """
    full = f"key bigint, digest bigint, more bigint, windows int, doc_id bigint, start int, anchor int, salt int, {name} {ddl}"
    schema = arrow_schema(full)

    def rows(batches):
        for batch in batches:
            if documents is not None:
                batch = batch.filter(batch.column(0).is_valid())
                batch = batch.filter(pa.array(documents.value(batch.column(0).to_numpy())))
                if counter is not None:
                    counter.add(batch.num_rows)
            for ids, symbols, s, place in scan(kind, batch):
                here = np.flatnonzero(known.value(~s.key if only_several else s.key))
                s = Segments(*(x[here] for x in s))
                deep = known.value(~s.key)
                extra = np.full(len(deep), None, dtype=object)
                at = np.flatnonzero(deep)
                extra[at] = detail(symbols, Segments(*(x[at] for x in s)))
                own = _class(kind, symbols, s)
                salt = _salts(popular.value if popular else (own[1][:0], own[2][:0]), own[1].to_numpy(), own[2].to_numpy(), ids[s.row] + s.start)
                columns = [*own, *(pa.array(x).cast(f.type) for x, f in zip((ids[s.row], s.start + place, s.anchor, salt), list(schema)[4:], strict=False))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(extra, schema.field(name).type)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, full)


POPULAR = 10_000  # a segment's places from which they are dealt to SALTS tasks
MOST_POPULAR = 100_000
SALTS = 64


def popular_segments(info: DataFrame, total: int):
    """The least number of times of a popular segment, and the contents of all such; broadcast.

    ``total`` is the sum of all times.  More than ``POPULAR`` times, and more than one in ``MOST_POPULAR`` of all, can be no more than that many segments.
    """
    least = max(POPULAR, total // MOST_POPULAR)
    rows = info.where(F.col("times") > least).select("digest", "more").toArrow().sort_by([("digest", "ascending"), ("more", "ascending")])
    return least, info.sparkSession.sparkContext.broadcast((rows.column("digest").to_numpy(), rows.column("more").to_numpy()))


def _salts(popular: tuple[np.ndarray, np.ndarray], digest: np.ndarray, more: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A number for each place of a popular segment, 0 for all others."""
    if not len(popular[0]):
        return np.zeros(len(digest), dtype=np.int32)
    at = np.minimum(np.searchsorted(popular[0], digest), len(popular[0]) - 1)
    hit = (popular[0][at] == digest) & (popular[1][at] == more)
    return np.where(hit, (mix64(place.astype(np.int64).view(U64)) % U64(SALTS)).astype(np.int32), 0)


def with_info(places: DataFrame, info: DataFrame, least: int) -> DataFrame:
    """places joined with ``info`` (CLASS, times, ...); a popular segment's places are in several tasks."""
    salts = F.when(F.col("times") > least, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return places.join(info.withColumn("salt", F.explode(salts)), [*CLASS, "salt"]).drop("salt")


def object_array(values: list) -> np.ndarray:
    out = np.empty(len(values), dtype=object)
    out[:] = values
    return out


def by_document(spans: DataFrame) -> DataFrame:
    """(doc_id, from, to) rows as one array a document."""
    return spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("spans"))


def covered(spans, size: int) -> np.ndarray:
    """Mask of the symbols inside any of the half-open spans."""
    if not spans:
        return np.zeros(size, dtype=bool)
    edge = np.zeros(size + 1, dtype=np.int64)
    for s in spans:
        edge[min(s["from"], size)] += 1
        edge[min(s["to"], size)] -= 1
    return np.cumsum(edge)[:size] > 0
