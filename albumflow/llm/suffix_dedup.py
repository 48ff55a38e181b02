"""Suffix-array dedup: bytes inside any 400-byte string that stands in two places.

Whole segments that repeat are found by their contents' digests.  For the others, whose key
also occurs in unequal segments, suffixes are ordered by column-wise construction: each
segment is a document of one collection, all aligned at their minimiser, and each round
inserts one symbol of every document.  A round's insertion sorts the documents by the new
symbol, stably, within the order of the round before (the Burrows-Wheeler step), and
updates the common prefixes of neighbours by range minima.  A window repeats if, when its
first symbol is inserted, a neighbour's common prefix is at least the window.  Only
suffixes of one length can be equal windows, so just that column of the transform is kept;
the sequential files of the external method are the sorted shuffle partitions, read in
blocks of whole keys.  Keys with more than ``LARGE_KEY`` segments are not gathered: their
windows are compared by digests in an ordinary aggregation.

Edge cases: null and empty texts and texts under 400 bytes lose nothing.  Rows with a null
doc_id are neither searched nor cut.  Rows that repeat doc_id and text are two places.
Other columns are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumflow.llm.kernels import digests
from albumflow.llm.segments import CLASS, Kind, by_document, classes, covered, key_filter, object_array, occurrences, popular_segments, repeated_keys, with_info
from albumflow.llm.shared import arrow_map, arrow_schema, partitions, saved

LENGTH = 400
GRAM = 128
REACH = LENGTH - GRAM  # the most bytes of a window before its minimiser
PAD = 256  # a symbol outside the segment
BLOCK_ROWS = 4096
LARGE_KEY = 20_000


def _pieces(symbols, s):
    return object_array([bytes(x) for x in symbols.pieces(symbols.bounds[s.row] + s.start, s.windows + LENGTH - 1)])


def collection_repeats(group: np.ndarray, pieces: list[bytes], anchor: np.ndarray) -> np.ndarray:
    """For each piece and offset of a window in it: whether the window is in another piece of its group.

    ``group`` is in order; a piece's minimiser starts at ``anchor``.
    """
    m = len(pieces)
    columns = REACH + LENGTH
    symbols = np.full((columns, m), PAD, dtype=np.uint16)
    for i, (piece, a) in enumerate(zip(pieces, anchor, strict=True)):
        symbols[REACH - a : REACH - a + len(piece), i] = np.frombuffer(piece, dtype=np.uint8)
    _, dense = np.unique(group, return_inverse=True)
    lead = dense.astype(np.int64) * (PAD + 1)
    first = np.ones(m, dtype=bool)
    first[1:] = dense[1:] != dense[:-1]
    order = np.arange(m)
    prefix = np.where(first, -1, 0)  # with the row before; -1 starts a group
    repeats = np.zeros((m, REACH + 1), dtype=bool)
    for column in range(columns - 1, -1, -1):
        symbol = lead[order] + symbols[column, order]
        new = np.argsort(symbol, kind="stable")
        same = np.zeros(m, dtype=bool)
        same[1:] = symbol[new[1:]] == symbol[new[:-1]]
        at = np.flatnonzero(same)
        following = np.zeros(m, dtype=np.int64)
        if len(at):
            ranges = np.stack([new[at - 1] + 1, new[at] + 1], axis=1).ravel()
            following[at] = np.minimum.reduceat(np.append(prefix, 0), ranges)[::2] + 1
        following[first] = -1
        order, prefix = order[new], following
        if column <= REACH:
            long = prefix >= LENGTH
            long[:-1] |= long[1:]
            offset = anchor[order] - (REACH - column)
            hit = long & (offset >= 0)
            repeats[order[hit], offset[hit]] = True
    return repeats


def _spans_of(repeats: np.ndarray, rows: np.ndarray, windows: np.ndarray, start: np.ndarray):
    """Row numbers and byte ranges of the runs of repeated windows."""
    row, at, to = [], [], []
    for i in np.flatnonzero(rows):
        flags = np.zeros(int(windows[i]) + 2, dtype=np.int8)
        flags[1:-1] = repeats[i, : windows[i]]
        edge = np.flatnonzero(np.diff(flags))
        for a, b in zip(edge[::2], edge[1::2], strict=True):
            row.append(i)
            at.append(int(start[i] + a))
            to.append(int(start[i] + b + LENGTH - 1))
    return row, at, to


_SPAN = "doc_id bigint, from int, to int"


def _sorted_collections(pieces: DataFrame) -> DataFrame:
    """Repeated byte ranges of single segments, by column-wise construction in each partition."""
    schema = arrow_schema(_SPAN)

    def solve(rows: pa.Table):
        key, anchor, windows, start, times, doc = (rows.column(c).to_numpy() for c in ("key", "anchor", "windows", "start", "times", "doc_id"))
        repeats = collection_repeats(key, rows.column("piece").to_pylist(), anchor)
        row, at, to = _spans_of(repeats, (times == 1) & repeats.any(axis=1), windows, start)
        return pa.RecordBatch.from_arrays([pa.array(doc[row], pa.int64()), pa.array(at, pa.int32()), pa.array(to, pa.int32())], schema=schema)

    def run(batches):
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count < BLOCK_ROWS:
                continue
            rows = pa.Table.from_batches(held)
            key = rows.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
            if cut:
                yield solve(rows.slice(0, cut))
            held = rows.slice(cut).to_batches()
            count = rows.num_rows - cut
        if count:
            yield solve(pa.Table.from_batches(held))

    dealt = pieces.repartition(partitions(pieces), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, _SPAN)


def _hashed_windows(pieces: DataFrame) -> DataFrame:
    """The same for keys with very many segments, by an aggregation over digests of windows."""
    ddl = "key bigint, digest bigint, more bigint, doc_id bigint, from int, times bigint"
    schema = arrow_schema(ddl)

    def explode(batch):
        for key, piece, windows, start, times, doc in zip(*(batch.column(c).to_pylist() for c in ("key", "piece", "windows", "start", "times", "doc_id")), strict=True):
            view = memoryview(piece)
            own = digests(view[i : i + LENGTH] for i in range(windows))
            key, doc, times = (pa.array(np.full(windows, x)) for x in (key, doc, times))
            at = pa.array((start + np.arange(windows)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([key, pa.array(own[:, 0]), pa.array(own[:, 1]), doc, at, times], schema=schema)

    windows = arrow_map(pieces, explode, ddl)
    again = windows.groupBy("key", "digest", "more").agg(F.count("*").alias("places")).where("places > 1")
    hits = windows.where("times = 1").join(again, ["key", "digest", "more"], "left_semi")
    return hits.select("doc_id", "from", (F.col("from") + LENGTH).alias("to"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, spans: the byte ranges of every document that stand elsewhere too."""
    kind = Kind(False, LENGTH, GRAM)
    found = saved(classes(docs, kind))
    keys = saved(repeated_keys(found))
    total, known = key_filter(keys)
    info = saved(found.join(keys.select("key", "kinds"), "key").select(*CLASS, "times", "kinds"))
    least, popular = popular_segments(info, total)
    places = saved(with_info(occurrences(docs, kind, known, "piece", "binary", _pieces, popular=popular), info, least))
    whole = places.where("times > 1").select("doc_id", F.col("start").alias("from"), (F.col("start") + F.col("windows") + LENGTH - 1).alias("to"))
    pieces = places.where("kinds > 1").groupBy(*CLASS)
    pieces = pieces.agg(*(F.first(c).alias(c) for c in ("anchor", "piece", "start", "times", "kinds", "doc_id")))
    columns = ["key", "anchor", "windows", "start", "times", "doc_id", "piece"]
    small = _sorted_collections(pieces.where(F.col("kinds") <= LARGE_KEY).select(*columns))
    large = _hashed_windows(pieces.where(F.col("kinds") > LARGE_KEY).select(*columns))
    return saved(by_document(whole.unionByName(small).unionByName(large)))


def remove_bytes(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (bytes), kept_sha256."""
    ddl = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string"
    schema = arrow_schema(ddl)

    def cut(batch):
        texts = pc.fill_null(batch.column(1), "").cast(pa.large_binary())
        out = []
        for text, own in zip(texts, batch.column(2).to_pylist(), strict=True):
            data = bytes(text.as_buffer())
            kept, lost, runs = data, 0, 0
            if own:
                gone = covered(own, len(data))
                lost = int(gone.sum())
                runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            out.append((len(data), lost, runs, kept, hashlib.sha256(kept).hexdigest()))
        arrays = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), list(schema)[1:], strict=True)] if out else [pa.array([], f.type) for f in list(schema)[1:]]
        yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], schema=schema)

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text").join(spans, "doc_id", "left"), cut, ddl)


def dedup(docs: DataFrame) -> DataFrame:
    """``remove_bytes`` of the repeated spans of docs."""
    docs = docs.select("doc_id", "text")
    return remove_bytes(docs, repeated_spans(docs))
