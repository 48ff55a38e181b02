"""Substring dedup with a log-structured fingerprint index.

The index is a list of immutable runs in the shared folder, one a batch; once there are
``FANOUT`` of them, they are compacted to one before the next.  A run is two tables, bucketed and sorted: the distinct segments of its
windows, and their keys.  A new batch's run is merge-joined with each run of history bucket by bucket,
so history is neither shuffled nor sorted again.  What has a key in common is verified on digests of whole
windows' words.  The texts of history are not read for that, but for the first document of each segment whose key the new batch
meets with other content: the earliest document with a window is the first one with some segment around it.  Batches must come in rising order of doc_id: a window is judged against all documents with
a smaller doc_id, in its batch or earlier.

Edge cases: null and empty texts, and texts with fewer words than a window, lose nothing.
A null doc_id is not smaller than any other and has none smaller: its words stay and
remove nothing.  Rows that repeat doc_id and text do not judge each other and get the same result.
Other columns are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from albumflow.llm import bloom
from albumflow.llm.kernels import digests
from albumflow.llm.segments import CLASS, Kind, by_document, classes, covered, key_filter, object_array, occurrences, popular_segments, with_info
from albumflow.llm.shared import arrow_map, arrow_schema, new_folder, partitions, remove_folder, saved

WINDOW = 50
GRAM = 16
FANOUT = 2
BATCHES = 3
CONTENT = CLASS[1:]


class Run(NamedTuple):
    """Names of a run's tables: segments (CLASS, first, times), and keys (the ranges of CONTENT, times)."""

    segments: str
    keys: str


def _keys(segments: DataFrame) -> DataFrame:
    """A key's segments are all equal if least and greatest of their contents are."""
    ends = [f(c).alias(f"{name}_{c}") for c in CONTENT for name, f in (("low", F.min), ("high", F.max))]
    return segments.groupBy("key").agg(*ends, F.sum("times").alias("times"))


def _joined_keys(keys: DataFrame) -> DataFrame:
    ends = [f(f"{name}_{c}").alias(f"{name}_{c}") for c in CONTENT for name, f in (("low", F.min), ("high", F.max))]
    return keys.groupBy("key").agg(*ends, F.sum("times").alias("times"))


def _joined_segments(segments: DataFrame) -> DataFrame:
    return segments.groupBy(*CLASS).agg(F.min("first").alias("first"), F.sum("times").alias("times"))


def _window_digests(symbols, s):
    """128 bits of each window, of every segment."""
    first = np.repeat(symbols.bounds[s.row] + s.start, s.windows)
    ends = np.cumsum(s.windows)
    first += np.arange(len(first)) - np.repeat(ends - s.windows, s.windows)
    own = digests(symbols.pieces(first, np.full(len(first), WINDOW))).view("V16").ravel()
    return object_array([[x.tobytes() for x in own[a:b]] for a, b in zip(ends - s.windows, ends, strict=True)])


class FingerprintIndex:
    """Historical windows of all batches so far."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.kind = Kind(True, WINDOW, GRAM)
        self.folder = new_folder(spark, "fingerprints")
        self.runs: list[Run] = []
        self._tables: set[str] = set()
        self.read_again = spark.sparkContext.accumulator(0)  # texts of history that verification read

    def _table(self, rows: DataFrame, by: list[str]) -> str:
        """Write rows as a table whose buckets are the partitions of an aggregation by the same columns."""
        name = f"fingerprints_{uuid.uuid4().hex}"
        self._tables.add(name)
        bucketed = rows.write.format("parquet").bucketBy(partitions(rows), *by).sortBy(*by)
        bucketed.option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _write(self, segments: DataFrame) -> Run:
        name = self._table(segments, CLASS)
        return Run(name, self._table(_keys(self.spark.table(name)), ["key"]))

    def _delete(self, names: Iterable[str]) -> None:
        for name in list(names):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove_folder(self.spark, f"{self.folder}/{name}")
            self._tables.discard(name)

    def compact(self) -> None:
        """Merge all runs into one."""
        every = None
        for run in self.runs:
            own = self.spark.table(run.segments)
            every = own if every is None else every.unionByName(own)
        old, self.runs = self.runs, [self._write(_joined_segments(every))]
        for run in old:
            self._delete(run)

    def add(self, batch: DataFrame, history: DataFrame | None = None) -> DataFrame:
        """Index a batch; returns (doc_id, spans), the word ranges it repeats.

        ``history`` holds the documents of earlier batches, for verification.
        """
        if len(self.runs) >= self.fanout:
            self.compact()
        run = self._write(classes(batch, self.kind))
        new_segments, new_keys = self.spark.table(run.segments), self.spark.table(run.keys)
        keys, segments = new_keys, new_segments
        for past in self.runs:
            keys = keys.unionByName(self.spark.table(past.keys).hint("merge").join(new_keys.select("key"), "key", "left_semi"))
            segments = segments.unionByName(self.spark.table(past.segments).hint("merge").join(new_segments.select(*CLASS), CLASS, "left_semi"))
        unequal = F.lit(False)
        for c in CONTENT:
            unequal = unequal | (F.col(f"low_{c}") < F.col(f"high_{c}"))
        kinds = F.when(unequal, 2).otherwise(1)
        keys = saved(_joined_keys(keys).where(unequal | (F.col("times") > 1)).select("key", kinds.alias("kinds"), "times"))
        total, known = key_filter(keys)
        info = saved(_joined_segments(segments).join(keys.select("key", "kinds"), "key").select(*CLASS, "first", "times", (F.col("kinds") > 1).alias("several")))
        least, popular = popular_segments(info, total)
        places = occurrences(batch, self.kind, known, "hashes", "array<binary>", _window_digests, popular=popular)
        found = saved(with_info(places.drop("anchor"), info, least))
        whole = found.where("first < doc_id").select("doc_id", F.col("start").alias("from"), (F.col("start") + F.col("windows") + WINDOW - 1).alias("to"))
        # Only the first document with a segment still has windows to judge: later ones lose them all.
        place = "doc_id", "key", F.posexplode("hashes").alias("at", "hash"), "start"
        mine = found.where("several and first = doc_id").select(*place)
        ends = F.col("start") + F.col("at")
        mine = mine.select("key", "hash", "doc_id", ends.alias("from"), (ends + WINDOW).alias("to"))
        seen = mine.select("key", "hash", "doc_id")
        if history is not None and self.runs:
            first = self._first_documents(known, keys)
            old = occurrences(history, self.kind, known, "hashes", "array<binary>", _window_digests, only_several=True, documents=first, counter=self.read_again)
            old = old.join(keys.where("kinds > 1"), "key", "left_semi")
            seen = seen.unionByName(old.select("key", F.explode("hashes").alias("hash"), "doc_id"))
        firsts = seen.groupBy("key", "hash").agg(F.min("doc_id").alias("least"))
        part = mine.join(firsts, ["key", "hash"]).where("least < doc_id").select("doc_id", "from", "to")
        spans = saved(by_document(whole.unionByName(part)))
        self.runs.append(run)
        return spans

    def _first_documents(self, known, keys: DataFrame):
        """A filter of the first documents of history's segments whose key has several; broadcast."""
        schema = arrow_schema("key bigint, doc_id bigint")

        def possible(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays(batch.filter(pa.array(known.value(~batch.column(0).to_numpy()))).columns, schema=schema)

        every = None
        for past in self.runs:
            own = self.spark.table(past.segments).select("key", F.col("first").alias("doc_id")).mapInArrow(possible, "key bigint, doc_id bigint")
            every = own if every is None else every.unionByName(own)
        first = saved(every.join(keys.where("kinds > 1").select("key"), "key", "left_semi").select("doc_id").distinct())
        return self.spark.sparkContext.broadcast(bloom.build(first, first.count()))

    def drop(self) -> None:
        """Delete the index's tables, those of a batch that failed as well."""
        self._delete(self._tables)
        remove_folder(self.spark, self.folder)


def remove_words(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, spans, kept_text (kept words joined by one space)."""
    ddl = "doc_id bigint, n_words bigint, n_removed bigint, spans array<struct<from:int,to:int>>, kept_text string"
    schema = arrow_schema(ddl)

    def cut(batch):
        texts = pc.fill_null(batch.column(1), "").cast(pa.large_binary())
        sizes, lost, kept = [], [], []
        for text, own in zip(texts, batch.column(2).to_pylist(), strict=True):
            words = bytes(text.as_buffer()).split()  # ASCII white space: 0x20 and 0x09-0x0D
            sizes.append(len(words))
            if own:
                gone = covered(own, len(words))
                lost.append(int(gone.sum()))
                words = [w for w, g in zip(words, gone, strict=True) if not g]
            else:
                lost.append(0)
            kept.append(b" ".join(words))
        text = pa.array(kept, pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(lost, pa.int64()), batch.column(2).cast(schema.field("spans").type), text], schema=schema)

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text").join(spans, "doc_id", "left"), cut, ddl)


def batches_of(docs: DataFrame, count: int) -> list[DataFrame]:
    """docs in ``count`` ranges of doc_id, rising; rows with a null id come first."""
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None or high - low < count:
        return [docs]
    step, doc = (high - low + count) // count, F.col("doc_id")
    between = [(doc >= low + i * step) & (doc < low + (i + 1) * step) for i in range(1, count)]
    return [docs.where(x) for x in (doc.isNull() | (doc < low + step), *between)]


def dedup(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Feed docs to a new index in batches; returns ``remove_words`` of all of them."""
    docs = docs.select("doc_id", "text")
    index = FingerprintIndex(docs.sparkSession)
    spans = None
    done: DataFrame | None = None
    try:
        for batch in batches_of(docs, batches):
            found = index.add(batch, done)
            spans = found if spans is None else spans.unionByName(found)
            done = batch if done is None else done.unionByName(batch)
    finally:
        index.drop()
    return remove_words(docs, spans)
