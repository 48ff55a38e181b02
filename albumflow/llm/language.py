"""Language identification with a byte convolutional network, trained in numpy.

Texts are cut into windows of ``LENGTH`` bytes that together cover every byte.  Filters of
several widths slide over one-hot bytes; each filter's greatest answer in the window, past
a rectifier, feeds a softmax over the languages.  A text's probabilities are the softmax
of its windows' mean log-probabilities, weighted by bytes.  Scoring looks up byte pairs,
so a filter of width 6 costs three table reads a byte.

Training reads at most ``TRAIN_ROWS`` labelled rows (smallest hash of doc_id) and
``TRAIN_WINDOWS`` windows of each; both bounds are parameters.  Short texts are learned too,
as one window.  Edge cases: a null text, or one without a letter, is ``und`` with score 0;
rows without a language or without text are not learned; with no row to learn from everything
is ``und``.  Repeated rows get the same prediction; other
columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumflow.llm.kernels import Texts, text_slices
from albumflow.llm.shared import arrow_schema, sample

LENGTH = 192
WIDTHS = (2, 4, 6)
FILTERS = 8
TRAIN_ROWS = 4000
TRAIN_WINDOWS = 4
SHORT = 64  # a training text's last window is left out if it has fewer bytes, unless it is the only one
STEPS = 1200
BATCH = 64
RATE = 0.02
BLOCK = 96  # windows scored at a time
UNKNOWN = "und"


class Model(NamedTuple):
    languages: list[str]
    filters: list[np.ndarray]  # for each width: (width, 256, FILTERS)
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray

    def tables(self) -> list[np.ndarray]:
        """Sums of two filter rows for each byte pair; table j serves offsets 2j and 2j + 1."""
        out = []
        for j in range(max(WIDTHS) // 2):
            own = [f for f in self.filters if len(f) > 2 * j]
            out.append(np.concatenate([(f[2 * j][:, None] + f[2 * j + 1][None]).reshape(65536, -1) for f in own], axis=1))
        return out


def cut_windows(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, bytes in it, and the LENGTH + 5 bytes from each window's start (0 past the text)."""
    size = np.diff(texts.bounds)
    count = -(-size // LENGTH)
    row = np.repeat(np.arange(texts.count), count)
    first = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = texts.bounds[row] + first * LENGTH
    room = texts.bounds[row + 1] - start
    span = np.arange(LENGTH + max(WIDTHS) - 1)
    padded = np.append(texts.data, np.zeros(len(span), np.uint8))
    data = np.where(span < room[:, None], padded[start[:, None] + span], 0).astype(np.uint8)
    return row, np.minimum(room, LENGTH), data


def _pooled(filters: list[np.ndarray], data: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Greatest answer of each filter in each window, and where."""
    best, where = [], []
    for f in filters:
        answers = sum(f[o][data[:, o : o + LENGTH]] for o in range(len(f)))
        at = answers.argmax(axis=1)
        where.append(at)
        best.append(np.take_along_axis(answers, at[:, None], axis=1)[:, 0])
    return np.concatenate(best, axis=1), where


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class _Adam:
    def __init__(self, values: list[np.ndarray]):
        self.values, self.m, self.v, self.t = values, [np.zeros_like(x) for x in values], [np.zeros_like(x) for x in values], 0

    def step(self, grads: list[np.ndarray], rate: float) -> None:
        self.t += 1
        for x, g, m, v in zip(self.values, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)


def fit(data: np.ndarray, label: np.ndarray, languages: list[str], steps: int = STEPS, seed: int = 11) -> Model:
    """Train on windows by back-propagation through the max pooling."""
    rng = np.random.default_rng(seed)
    k, features = len(languages), FILTERS * len(WIDTHS)
    filters = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    bias, offset = np.zeros(features, np.float32), np.zeros(k, np.float32)
    dense = rng.normal(0, 0.3, (features, k)).astype(np.float32)
    params = [*filters, bias, dense, offset]
    adam = _Adam(params)
    share = np.bincount(label, minlength=k).astype(float)
    chance = (1 / np.maximum(share, 1))[label]
    chance /= chance.sum()
    cumulative = np.cumsum(chance)
    for step in range(steps):
        pick = np.minimum(np.searchsorted(cumulative, rng.random(BATCH)), len(label) - 1)
        x, y = data[pick], label[pick]
        pooled, where = _pooled(filters, x)
        hidden = np.maximum(pooled + bias, 0)
        error = _softmax(hidden @ dense + offset)
        error[np.arange(BATCH), y] -= 1
        error /= BATCH
        back = (error @ dense.T) * (hidden > 0)
        grads = []
        for i, (f, at) in enumerate(zip(filters, where, strict=True)):
            g = np.zeros_like(f)
            mine = back[:, i * FILTERS : (i + 1) * FILTERS]
            for o in range(len(f)):
                byte = np.take_along_axis(x, at + o, axis=1)
                np.add.at(g[o], (byte, np.arange(FILTERS)), mine)
            grads.append(g + 1e-5 * f)
        grads += [back.sum(axis=0), hidden.T @ error, error.sum(axis=0)]
        adam.step([g.astype(np.float32) for g in grads], RATE * (1 - step / steps) + 1e-4)
    return Model(languages, filters, bias, dense, offset)


def train(docs: DataFrame, labelled: DataFrame, limit: int = TRAIN_ROWS) -> Model:
    """Fit to rows (text, lang) of ``labelled``, a part of docs."""
    rows = sample(labelled.where("lang is not null").select("doc_id", "lang", "text"), limit)
    ddl = "doc_id bigint, lang string, part int, data binary"
    schema = arrow_schema(ddl)

    def extract(batches):
        for batch in batches:
            for texts in text_slices(batch.column(2)):
                row, room, data = cut_windows(texts)
                number = np.arange(len(row)) - np.searchsorted(row, row)
                count = np.bincount(row, minlength=texts.count)[row]
                step = np.maximum(1, count // TRAIN_WINDOWS)
                take = np.flatnonzero(((room >= SHORT) | (number == 0)) & (number % step == 0) & (number < step * TRAIN_WINDOWS))
                rows = pa.array(texts.first + row[take])
                columns = [batch.column(0).cast(pa.int64()).take(rows), batch.column(1).take(rows), pa.array(number[take].astype(np.int32)), pa.array([data[i].tobytes() for i in take], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = rows.mapInArrow(extract, ddl).toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending"), ("part", "ascending")])
    names = rows.column("lang").to_pylist()
    languages = sorted(set(names))
    if not languages:
        return Model([], [], *(np.zeros(0, np.float32) for _ in range(3)))
    data = np.frombuffer(b"".join(rows.column("data").to_pylist()), np.uint8).reshape(len(names), -1)
    return fit(data, np.array([languages.index(x) for x in names]), languages)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    ddl = "doc_id bigint, lang_pred string, score double"
    schema = arrow_schema(ddl)
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def logs(model: Model, tables: list[np.ndarray], data: np.ndarray) -> np.ndarray:
        pairs = (data[:, :-1].astype(np.uint16) << 8) | data[:, 1:]
        answers = tables[0][pairs[:, :LENGTH]]
        for j, more in enumerate(tables[1:], 1):
            answers[:, :, -more.shape[1] :] += more[pairs[:, 2 * j : 2 * j + LENGTH]]
        p = _softmax(np.maximum(answers.max(axis=1) + model.bias, 0) @ model.dense + model.offset)
        return np.log(np.maximum(p, 1e-12))

    def run(batches):
        model = spread.value
        tables = model.tables() if model.languages else []
        for batch in batches:
            known = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for texts in text_slices(batch.column(1)):
                part = slice(texts.first, texts.first + texts.count)
                best, score = np.full(texts.count, -1), np.zeros(texts.count)
                if model.languages:
                    row, room, data = cut_windows(texts)
                    total = np.zeros((texts.count, len(model.languages)))
                    for i in range(0, len(row), BLOCK):
                        at = slice(i, i + BLOCK)
                        np.add.at(total, row[at], logs(model, tables, data[at]) * room[at, None])
                    p = _softmax(total / np.maximum(np.diff(texts.bounds), 1)[:, None])
                    best = np.where(known[part], p.argmax(axis=1), -1)
                    score = np.where(known[part], p.max(axis=1), 0.0)
                names = np.array([*model.languages, UNKNOWN], dtype=object)[best]
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], pa.array(names, pa.string()), pa.array(score)], schema=schema)

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select(F.col("doc_id").cast("long"), "text", letters.alias("letters")).mapInArrow(run, ddl)
