"""Target-distribution importance resampling by bit-sliced aggregation.

1. Features are all runs of 1 to ``ngrams`` consecutive words, repeats counted; a feature's bucket is
   its CRC-32 modulo ``BUCKETS``.  Tasks count the buckets of all raw and of all target texts
   in vectors of that length, which are added up.
2. A bucket's gain is the floored, scaled logarithm of its smoothed share among target features over
   that among raw ones.  Gains are cut into bit planes by sign: bit b of plane j
   says whether 2^j is part of bucket b's gain.
3. A document's bucket counts become planes of ``BUCKETS`` bits too.  ANDing a count plane k with a gain
   plane j and counting the bits that are left gives a multiple of 2^(k + j); these sums are the
   exact total of the document's gains.
4. Gumbel noise drawn from a hash of doc_id turns weights into scores, whose highest
   ``percent`` are a sample without replacement.  A histogram of scores (integers of a range bounded by the
   gains and by 32-bit noise) gives the rank at which each score begins, so no task
   sorts all documents; only rows of one score are numbered together.

Edge cases: null and empty texts have no features and weight 0; rows that repeat a doc_id are
ranked one by one, side by side; a null doc_id has no noise, so its score and rank are null and it is not drawn,
though its words count; an empty raw table gives an empty result, an empty target is smoothed like any
other; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from albumflow.llm.kernels import MARKS, Texts, Words, joined_words, split_words, table, text_slices
from albumflow.llm.shared import arrow_schema, saved

BUCKETS = 10_000
SCALE = 1000
SHORTEST = 20  # words of a document that may be drawn
SEED = 2024
_TOGETHER = 64  # documents whose counts are cut into planes at once
_LONG = 64  # bytes of features that are hashed one by one


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of the byte ranges start:end of ``data``, a byte of all ranges at a time."""
    out = np.empty(len(start), dtype=np.uint32)
    size = end - start
    order = np.argsort(-np.minimum(size, _LONG + 1), kind="stable")
    order = order[np.searchsorted(-size[order], -_LONG) :]
    first, left = start[order], size[order]
    crc = np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    for i in range(int(left.max(initial=0))):
        n = int(np.searchsorted(-left, -i))  # ranges of more than i bytes come first
        crc[:n] = _CRC[(crc[:n] ^ data[first[:n] + i]) & 255] ^ (crc[:n] >> 8)
    out[order] = ~crc
    for i in np.flatnonzero(size > _LONG):
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes())
    return out


def feature_buckets(texts: Texts, words: Words, ngrams: int) -> tuple[np.ndarray, np.ndarray]:
    """Text within the slice, and bucket, of every feature."""
    data, start, end = joined_words(texts, words)
    row = np.repeat(np.arange(texts.count), np.diff(words.bounds))
    rows, buckets = [], []
    for n in range(1, ngrams + 1):
        last = len(row) - n + 1
        whole = np.flatnonzero(row[:last] == row[n - 1 :]) if last > 0 else np.zeros(0, np.int64)
        rows.append(row[whole])
        buckets.append(crc32(data, start[whole], end[whole + n - 1]) % np.uint32(BUCKETS))
    return np.concatenate(rows), np.concatenate(buckets).astype(np.int64)


def _slices(column: pa.Array, ngrams: int):
    for texts in text_slices(pc.ascii_lower(pc.fill_null(column, ""))):
        words = split_words(texts, MARKS)
        yield texts, np.diff(words.bounds), *feature_buckets(texts, words, ngrams)


def bucket_counts(texts: DataFrame, ngrams: int = 1) -> np.ndarray:
    """How many features of all texts (one string column) fall in each bucket."""
    ddl = "bucket int, count bigint"
    schema = arrow_schema(ddl)

    def run(batches):
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for *_, bucket in _slices(batch.column(0), ngrams):
                total += np.bincount(bucket, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield table(schema, at, total[at])

    rows = texts.mapInArrow(run, ddl).groupBy("bucket").agg(F.sum("count").alias("count")).toArrow()
    out = np.zeros(BUCKETS, dtype=np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("count").to_numpy()
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored gains of all buckets, in doubles."""
    s, t = float(raw.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    gains = (math.floor(SCALE * math.log(((y + 1.0) * s) / ((x + 1.0) * t))) for x, y in zip(raw.tolist(), target.tolist(), strict=True))
    return np.fromiter(gains, np.int64, BUCKETS)


def bit_planes(counts: np.ndarray) -> np.ndarray:
    """Bits of whole numbers: (bits, rows, words of 64), from (rows, buckets)."""
    bits = max(1, int(counts.max(initial=0)).bit_length())
    packed = np.zeros((bits, len(counts), -(-counts.shape[1] // 64) * 8), dtype=np.uint8)
    for k in range(bits):
        plane = np.packbits((counts >> k) & 1 == 1, axis=1)
        packed[k, :, : plane.shape[1]] = plane
    return packed.view(np.uint64)


class Gains(NamedTuple):
    """Planes of the gains above and below zero."""

    above: np.ndarray
    below: np.ndarray

    def totals(self, counts: np.ndarray) -> np.ndarray:
        """Exact sum of counts times gains of each row, from counts (rows, buckets)."""
        total = np.zeros(len(counts), dtype=np.int64)
        for k, plane in enumerate(bit_planes(counts)):
            used = plane.any(axis=1)
            rows = plane[used]
            for sign, planes in ((1, self.above), (-1, self.below)):
                for j, gain in enumerate(planes):
                    total[used] += sign * (np.bitwise_count(rows & gain).sum(axis=1, dtype=np.int64) << (k + j))
        return total


def sliced(gains: np.ndarray) -> Gains:
    return Gains(*(bit_planes(np.maximum(sign * gains, 0)[None, :])[:, 0] for sign in (1, -1)))


def weights(docs: DataFrame, gains: np.ndarray, ngrams: int = 1) -> DataFrame:
    """doc_id, n_words, n_features, weight (the floored mean gain of its features) of every row."""
    ddl = "doc_id bigint, n_words bigint, n_features bigint, weight bigint"
    schema = arrow_schema(ddl)
    spread = docs.sparkSession.sparkContext.broadcast(sliced(gains))

    def run(batches):
        planes = spread.value
        for batch in batches:
            for texts, n_words, row, bucket in _slices(batch.column(1), ngrams):
                features = np.bincount(row, minlength=texts.count)
                order = np.argsort(row, kind="stable")
                row, bucket = row[order], bucket[order]
                total = np.zeros(texts.count, dtype=np.int64)
                for at in range(0, texts.count, _TOGETHER):
                    to = min(at + _TOGETHER, texts.count)
                    own = slice(*np.searchsorted(row, [at, to]))
                    counts = np.bincount((row[own] - at) * BUCKETS + bucket[own], minlength=(to - at) * BUCKETS)
                    total[at:to] = planes.totals(counts.reshape(to - at, BUCKETS).astype(np.uint32))
                part = slice(texts.first, texts.first + texts.count)
                yield table(schema, batch.column(0)[part], n_words, features, total // np.maximum(features, 1))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ddl)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Floored, scaled Gumbel noise of an id, from the first 32 bits of its hash."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, ngrams: int = 1, seed: int = SEED, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs; rank is null for rows not drawn.

    ``target`` has a column ``text`` whose distribution is aimed at; ``percent`` of the documents with at least
    ``shortest`` words are drawn.
    """
    gains = bucket_gains(bucket_counts(docs.select("text"), ngrams), bucket_counts(target.select("text"), ngrams))
    scored = saved(weights(docs, gains, ngrams).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    able = F.coalesce((F.col("n_words") >= shortest) & F.col("score").isNotNull(), F.lit(False))
    sizes = scored.where(able).groupBy("score").agg(F.count("*").alias("rows")).orderBy(F.desc("score")).collect()
    drawn = percent * sum(r.rows for r in sizes) // 100
    begins, before = [], 0
    for r in sizes:
        if before < drawn:
            begins.append((r.score, before))
            before += r.rows
    begins = docs.sparkSession.createDataFrame(begins, "score bigint, before bigint")
    marked = scored.join(F.broadcast(begins), "score", "left").withColumn("before", F.when(able, F.col("before")))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    place = F.col("before") + F.row_number().over(Window.partitionBy("score").orderBy("doc_id", "n_features", "weight"))
    chosen = marked.where("before IS NOT NULL").withColumn("rank", place).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return chosen.select(columns).unionByName(marked.where("before IS NULL").withColumn("rank", F.lit(None).cast("long")).select(columns))
