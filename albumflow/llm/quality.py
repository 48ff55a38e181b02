"""Quality classifier: hashed word n-gram logistic regression, trained with FTRL-proximal.

Features of a text are its words, word pairs, word shapes (which kinds of characters, the
last one, the length) and shape pairs, hashed to ``DIMENSIONS`` weights; a pair of equal
words also counts as a shape of its own, so that stuttering is seen in unknown words.
Each group's values are its frequencies in the text, so long texts do not outweigh.
Scores are sparse dot products, summed by text.

Training reads at most ``TRAIN_ROWS`` labelled rows, those with the smallest hash of
doc_id, in one task; that bound is a parameter.  Edge cases: a null or empty text has no feature and
scores by the bias alone; rows without a label are not learned; no labelled row at all
gives 0.5 everywhere; repeated rows score alike; other columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from albumflow.llm.kernels import BYTE_VALUES, RunningHash, Texts, U64, mix64, split_words, text_slices
from albumflow.llm.shared import arrow_schema, sample

DIMENSIONS = 1 << 20
TRAIN_ROWS = 8000
EPOCHS = 3
THRESHOLD = 0.3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-3
SCALE = 10.0

_KIND = np.full(256, 16, dtype=np.uint8)  # other marks
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 4
_KIND[128:] = 8
_LETTERS = 1 | 2 | 8


class Model(NamedTuple):
    weights: np.ndarray
    bias: float

    def __call__(self, logits: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(logits + self.bias, -30, 30)))


def features(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, feature number and value of every feature occurrence."""
    words = split_words(texts)
    count = np.diff(words.bounds)
    if not len(words.start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    row = np.repeat(np.arange(texts.count), count)
    word = RunningHash(BYTE_VALUES[texts.data])(words.start, words.end)
    kinds = np.bitwise_or.reduceat(_KIND[texts.data], words.start).astype(U64)
    last = texts.data[words.end - 1]
    size = np.minimum(words.end - words.start, 20).astype(U64)
    shape = mix64(kinds | (np.where(_KIND[last] & _LETTERS, 0, last).astype(U64) << U64(8)) | (size >> U64(2) << U64(16)))
    pair = np.flatnonzero(row[1:] == row[:-1])
    equal = word[pair] == word[pair + 1]
    shapes = mix64(np.where(equal, U64(1), shape[pair] * U64(3) + shape[pair + 1]))
    pairs = mix64(word[pair] * U64(5) + word[pair + 1])
    rows = np.concatenate([row, row[pair], row, row[pair]])
    number = (np.concatenate([word, pairs, shape, shapes]) % U64(DIMENSIONS)).astype(np.int64)
    return rows, number, (SCALE / count[rows]).astype(np.float32)


def _train_rows(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """label, doc_id, numbers, amounts of a bounded sample of labelled rows (doc_id, label), in one sorted partition."""
    ddl = "label int, doc_id bigint, numbers array<int>, amounts array<float>"
    schema = arrow_schema(ddl)
    few = sample(labels.where("label is not null and doc_id is not null"), limit)
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("label", "doc_id", "text")

    def extract(batches):
        for batch in batches:
            for texts in text_slices(batch.column(2)):
                row, number, value = features(texts)
                at, inverse = np.unique(row * DIMENSIONS + number, return_inverse=True)
                total = np.bincount(inverse, value, minlength=len(at)).astype(np.float32)
                bounds = pa.array(np.searchsorted(at // DIMENSIONS, np.arange(texts.count + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in ((at % DIMENSIONS).astype(np.int32), total)]
                part = slice(texts.first, texts.first + texts.count)
                columns = [batch.column(0)[part].cast(pa.int32()), batch.column(1)[part].cast(pa.int64()), *(x.cast(f.type) for x, f in zip(lists, list(schema)[2:], strict=True))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return rows.mapInArrow(extract, ddl).repartition(1).sortWithinPartitions("doc_id", "label")


def _fitted(rows: pa.Table, epochs: int) -> tuple[np.ndarray, float]:
    """Weights and bias after follow-the-regularised-leader updates by each row in turn."""
    z, n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
    label = rows.column("label").to_numpy()
    numbers, amounts = (rows.column(c).combine_chunks() for c in ("numbers", "amounts"))

    def weight(z, n):
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(label)):
            at = np.append(numbers[int(i)].values.to_numpy(), DIMENSIONS)
            x = np.append(amounts[int(i)].values.to_numpy(), 1.0)
            w = weight(z[at], n[at])
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - label[i]) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weight(z, n)
    return w[:-1].astype(np.float32), float(w[-1])


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS, epochs: int = EPOCHS) -> Model:
    """Fit to ``labels`` (doc_id, label 0 or 1) in one task, on the bounded sample; only the weights go to the driver."""
    ddl = "weights binary, bias double"
    schema = arrow_schema(ddl)

    def fit(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            weights, bias = _fitted(pa.Table.from_batches(held), epochs)
            yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([bias])], schema=schema)

    found = _train_rows(docs, labels, limit).mapInArrow(fit, ddl).collect()
    if not found:
        return Model(np.zeros(DIMENSIONS, np.float32), 0.0)
    return Model(np.frombuffer(found[0].weights, np.float32), found[0].bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row."""
    ddl = "doc_id bigint, score double"
    schema = arrow_schema(ddl)
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = spread.value
        for batch in batches:
            for texts in text_slices(batch.column(1)):
                row, number, value = features(texts)
                logits = np.bincount(row, model.weights[number] * value, minlength=texts.count)
                yield pa.RecordBatch.from_arrays([batch.column(0)[texts.first : texts.first + texts.count], pa.array(model(logits))], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ddl)


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of docs, all columns, that score at least ``threshold``."""
    spread = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        model = spread.value
        for batch in batches:
            for texts in text_slices(batch.column(at)):
                row, number, value = features(texts)
                logits = np.bincount(row, model.weights[number] * value, minlength=texts.count)
                yield batch.slice(texts.first, texts.count).filter(pa.array(model(logits) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def remainder(divisor: int) -> Column:
    """crc32 of doc_id as text, modulo ``divisor``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor
