"""Language-model scoring: a log-bilinear neural model beside smoothed token counts.

Token counts cover all training texts.  The neural model predicts a token's class (each
of the most frequent tokens, ``CLASSES`` by default, is one; all others share one) from the two tokens
before it: context vectors add up to a predicted vector whose products with the class
vectors, plus biases, are the scores.  It is trained in numpy by noise-contrastive
estimation, then normalised exactly: batched matrix products give the scores of every
class after every context, and so each context's log-normaliser.  A token of the shared
class gets the class's probability times its smoothed share of the class, so that the
probabilities of all tokens, and of one unseen one, add up to 1.

Counts of the most frequent tokens, ``HEAD`` at most, are broadcast; all other tokens
are joined with their counts.  The network learns from the counts of (class two before, class
before, class) over all tokens of all training texts.  Every kind is learned from in every round, however rare, with a weight in
proportion to its count; none is drawn by chance or left out.  The weights add up to the number of kinds at least.  The kinds stay in ``SHARDS`` tasks: in
each of ``ROUNDS`` rounds every task trains on its own kinds from the same vectors, and only the trained
vectors, of a size set by the number of classes, go to the driver to be averaged.

Edge cases: a null text is empty and has the end token alone; with no training text every
count is 0 and probabilities are uniform; rows that repeat doc_id and text score alike; other
columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumflow.llm.kernels import Texts, digests, signed, split_words, table, text_slices, word_hashes
from albumflow.llm.shared import arrow_schema, saved

CLASSES = 510  # unless the caller says otherwise
SHARDS, ROUNDS = 4, 4
HEAD = 1 << 18
WIDTH = 32
NOISE = 25
STEPS = 3000  # at least, in all shards
BATCH = 512
RATE = 0.1
END = -0x5EED  # the end token's number; words have hashes


class Counts(NamedTuple):
    """Counts of the most frequent tokens (sorted by hash), and of all."""

    hashes: np.ndarray
    counts: np.ndarray
    total: int
    distinct: int

    def of(self, tokens: np.ndarray) -> np.ndarray:
        """Counts of tokens; -1 of those outside the head."""
        if not len(self.hashes):
            return np.full(len(tokens), -1)
        at = np.minimum(np.searchsorted(self.hashes, tokens), len(self.hashes) - 1)
        return np.where(self.hashes[at] == tokens, self.counts[at], -1)


class Model(NamedTuple):
    """Log10 probabilities of classes: pair scores minus each context's normaliser."""

    tokens: np.ndarray  # sorted hashes of tokens that are classes of their own
    near: np.ndarray  # (token before, class) scores, biases included
    far: np.ndarray  # (token two before, class) scores
    normaliser: np.ndarray  # (two before, before)
    rest_total: int  # training tokens of the shared class, and distinct ones
    rest_distinct: int

    def classes(self, tokens: np.ndarray) -> np.ndarray:
        """Class of each token; the last class is shared."""
        if not len(self.tokens):
            return np.zeros(len(tokens), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        return np.where(self.tokens[at] == tokens, at, len(self.tokens))


def tokens_of(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of a slice, each text's words and then its end; bounds of each text."""
    words = split_words(texts)
    hashes = signed(word_hashes(texts, words, fold=True))
    bounds = words.bounds + np.arange(texts.count + 1)
    out = np.full(len(hashes) + texts.count, END, dtype=np.int64)
    place = np.ones(len(out), dtype=bool)
    place[bounds[1:] - 1] = False
    out[place] = hashes
    return out, bounds


def count_tokens(docs: DataFrame) -> DataFrame:
    """(token, count) over all texts."""
    schema = arrow_schema("token bigint, count bigint")

    def run(batches):
        for batch in batches:
            for texts in text_slices(batch.column(0), 1 << 22):
                yield table(schema, *np.unique(tokens_of(texts)[0], return_counts=True))

    rows = docs.select("text").mapInArrow(run, "token bigint, count bigint")
    return rows.groupBy("token").agg(F.sum("count").alias("count"))


def head_counts(counts: DataFrame) -> Counts:
    """Counts of the most frequent tokens, at most ``HEAD``, and the totals.

    A histogram of counts on a logarithmic scale gives the least count that belongs to the
    head, so no task sorts the vocabulary.  Tokens on one step of the scale are all in or all out.
    """
    step = F.floor(F.log2("count") * 16)
    sizes = counts.groupBy(step.alias("step")).agg(F.count("*").alias("tokens"), F.sum("count").alias("total")).collect()
    total, distinct = sum(r.total for r in sizes), sum(r.tokens for r in sizes)
    least, room = None, HEAD
    for r in sorted(sizes, key=lambda r: -r.step):
        room -= r.tokens
        if room < 0:
            break
        least = r.step
    head = counts.where(step >= least if least is not None else F.lit(False)).toArrow().sort_by("token")
    return Counts(head.column("token").to_numpy(), head.column("count").to_numpy(), total, distinct)


def _contexts(classes: np.ndarray, bounds: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes one and two before each token; ``start`` before a text's first."""
    one = np.empty_like(classes)
    one[1:], two = classes[:-1], np.empty_like(classes)
    one[bounds[:-1]] = start
    two[1:] = one[:-1]
    two[bounds[:-1]] = start
    return one, two


def count_contexts(docs: DataFrame, model: Model) -> DataFrame:
    """(code, count) over all tokens of all texts; a code stands for (two before, before, class)."""
    k = len(model.tokens) + 1
    schema = arrow_schema("code int, count bigint")

    def run(batches):
        for batch in batches:
            for texts in text_slices(batch.column(0), 1 << 22):
                tokens, bounds = tokens_of(texts)
                classes = model.classes(tokens)
                one, two = _contexts(classes, bounds, k)
                yield table(schema, *np.unique((two * (k + 1) + one) * (k + 1) + classes, return_counts=True))

    rows = docs.select("text").mapInArrow(run, "code int, count bigint")
    return rows.groupBy("code").agg(F.sum("count").alias("count"))


def weigh_contexts(contexts: DataFrame, seed: int = 5) -> DataFrame:
    """(shard, code, times): each context's weight, and in which of ``SHARDS`` shards it is, each in one partition.

    A code's weight is its exact share of all of them, a fraction where it is rare; so every code is there.
    """
    kinds, total = contexts.agg(F.count("*"), F.sum("count")).first()
    rate = max(STEPS * BATCH, kinds) / max(total or 0, 1)
    shard = F.pmod(F.xxhash64("code", F.lit(seed + 1)), F.lit(SHARDS)).cast("int").alias("shard")
    weighed = contexts.select(shard, "code", (F.col("count") * F.lit(rate)).alias("times"))
    return saved(weighed.repartitionByRange(SHARDS, "shard"))


class Network(NamedTuple):
    """Near and far context vectors, class vectors and biases, and the sums of their squared gradients."""

    params: tuple[np.ndarray, ...]
    squares: tuple[np.ndarray, ...]

    def packed(self) -> bytes:
        return b"".join(np.ascontiguousarray(x, dtype=np.float32).tobytes() for x in (*self.params, *self.squares))

    def unpacked(self, data: np.ndarray) -> Network:
        out, at = [], 0
        for x in (*self.params, *self.squares):
            out.append(data[at : at + x.size].reshape(x.shape).copy())
            at += x.size
        return Network(tuple(out[:4]), tuple(out[4:]))


def new_network(noise: np.ndarray, seed: int) -> Network:
    rng = np.random.default_rng(seed)
    k = len(noise)
    params = (*(rng.normal(0, 0.1, (n, WIDTH)) for n in (k + 1, k + 1, k)), np.log(noise))
    return Network(params, tuple(np.full(p.shape, 0.1) for p in params))


def steps_of(code: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes repeated so that no repeat weighs over 1, and the repeats' weights, which add up to each code's ``times``."""
    parts = np.ceil(times).astype(np.int64)
    return np.repeat(code, parts), np.repeat((times / parts).astype(np.float32), parts)


def _summed(index: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sums of rows by index."""
    order = np.argsort(index, kind="stable")
    index = index[order]
    first = np.flatnonzero(np.append(True, index[1:] != index[:-1]))
    out = np.zeros((size, *rows.shape[1:]))
    out[index[first]] = np.add.reduceat(rows[order], first)
    return out


def learn(net: Network, codes: np.ndarray, weights: np.ndarray, noise: np.ndarray, rng: np.random.Generator) -> None:
    """Train in place by noise-contrastive estimation.

    ``codes`` holds (two before, before, class) codes in random order, each of which is used
    in one step with its weight; ``noise`` the share of each class.  Context number ``len(noise)`` stands before a text.
    """
    k = len(noise)
    cumulative = np.cumsum(noise)
    near, far, out, bias = net.params
    lift = np.log(NOISE * noise)
    for at in range(0, len(codes), BATCH):
        code, weight = codes[at : at + BATCH].astype(np.int64), weights[at : at + BATCH].astype(float)
        two, one, word = code // (k + 1) ** 2, code // (k + 1) % (k + 1), code % (k + 1)
        false = np.minimum(np.searchsorted(cumulative, rng.random(NOISE)), k - 1)
        q = near[one] + far[two]
        true = weight * (1 / (1 + np.exp(-np.clip((q * out[word]).sum(1) + bias[word] - lift[word], -30, 30))) - 1)
        wrong = weight[:, None] / (1 + np.exp(-np.clip(q @ out[false].T + bias[false] - lift[false], -30, 30)))
        back = true[:, None] * out[word] + wrong @ out[false]
        both = np.append(word, false)
        grads = (
            _summed(one, back, k + 1), _summed(two, back, k + 1),
            _summed(both, np.concatenate([true[:, None] * q, wrong.T @ q]), k), _summed(both, np.append(true, wrong.sum(0)), k),
        )
        for p, g, s in zip(net.params, grads, net.squares, strict=True):
            g /= weight.sum()
            s += g * g
            p -= RATE * g / np.sqrt(s)


def fit(draws: DataFrame, frequency: np.ndarray, seed: int = 5) -> tuple[np.ndarray, ...]:
    """Near and far context vectors, class vectors and biases: rounds of training in tasks, averaged by their weights.

    ``draws`` is (shard, code, times) of ``weigh_contexts``; ``frequency`` the class counts, which are the noise.
    """
    noise = np.maximum(frequency, 0.5)
    noise = noise / noise.sum()
    net = new_network(noise, seed)
    spark = draws.sparkSession
    schema = arrow_schema("weight double, data binary")
    for turn in range(ROUNDS):
        spread = spark.sparkContext.broadcast(net)

        def run(batches, spread=spread, turn=turn):
            columns = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
            shard, code, times = (np.concatenate(x) for x in zip(*columns, strict=True)) if columns else (np.zeros(0),) * 3
            for own in np.unique(shard).tolist():
                order = np.flatnonzero(shard == own)
                order = order[np.argsort(code[order])]
                rng = np.random.default_rng([seed, turn, own])
                codes, weights = steps_of(code[order], times[order])
                mixed = rng.permutation(len(codes))
                mine = Network(*(tuple(x.copy() for x in part) for part in spread.value))
                learn(mine, codes[mixed], weights[mixed], noise, rng)
                yield table(schema, [times[order].sum()], [mine.packed()])

        total, weight = 0.0, 0.0
        for row in draws.mapInArrow(run, "weight double, data binary").collect():  # a row a shard
            total = total + row.weight * np.frombuffer(row.data, np.float32).astype(np.float64)
            weight += row.weight
        spread.unpersist()
        if weight:
            net = net.unpacked(total / weight)
    return net.params


def train(docs: DataFrame, counts: Counts, classes: int = CLASSES) -> Model:
    """Fit the network to the training texts ``docs``; the ``classes`` most frequent tokens have one of their own (1,288 at most)."""
    if not 0 <= classes <= 1288:
        raise ValueError("from 0 to 1,288 classes, so that a context's code is an int")
    top = np.argsort(-counts.counts, kind="stable")[:classes]
    own = np.sort(counts.hashes[top])
    frequency = counts.of(own)
    model = Model(own, *(np.zeros(0),) * 3, counts.total - int(frequency.sum()), counts.distinct - len(own))
    k = len(own) + 1
    near, far, out, bias = fit(weigh_contexts(saved(count_contexts(docs, model))), np.append(frequency, model.rest_total).astype(float))
    near_scores, far_scores = near @ out.T + bias, far @ out.T
    normaliser = np.empty((k + 1, k + 1))
    for two in range(k + 1):  # one matrix of scores at a time
        scores = near_scores + far_scores[two]
        most = scores.max(axis=1)
        normaliser[two] = most + np.log(np.exp(scores - most[:, None]).sum(axis=1))
    log10 = np.log(10.0)
    return model._replace(near=(near_scores / log10).astype(np.float32), far=(far_scores / log10).astype(np.float32), normaliser=(normaliser / log10).astype(np.float32))


def _logs(counts: Counts, model: Model, times, log):
    """log10 of the smoothed count share among all tokens, and within the shared class."""
    return (
        log((times + 0.5) / (counts.total + 0.5 * (counts.distinct + 1))),
        log((times + 0.5) / (model.rest_total + 0.5 * (model.rest_distinct + 1))),
    )


def score(docs: DataFrame, counts: DataFrame, head: Counts, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every row of docs.

    ``counts`` holds the counts of all tokens, ``head`` the most frequent of them.
    """
    spread = docs.sparkSession.sparkContext.broadcast((head, model))
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    main = "doc_id bigint, text_hash bigint, n_tokens bigint, n_known bigint, base_score double, score double, n_tail bigint"
    main_schema = arrow_schema(main)
    tail = "doc_id bigint, text_hash bigint, token bigint, times bigint"
    tail_schema = arrow_schema(tail)

    def text_hashes(texts):
        return digests(texts.data[a:b] for a, b in zip(texts.bounds[:-1], texts.bounds[1:], strict=True))[:, 0]

    def run(batches):
        head, model = spread.value
        k = len(model.tokens) + 1
        for batch in batches:
            for texts in text_slices(batch.column(1)):
                tokens, bounds = tokens_of(texts)
                row = np.repeat(np.arange(texts.count), np.diff(bounds))
                times = head.of(tokens)
                inside = times >= 0
                base, share = _logs(head, model, np.maximum(times, 0), np.log10)
                word = model.classes(tokens)
                one, two = _contexts(word, bounds, k)
                p = (model.near[one, word] + model.far[two, word] - model.normaliser[two, one]).astype(float)
                p += np.where(inside & (word == k - 1), share, 0.0)
                sums = [np.bincount(row, x, minlength=texts.count) for x in (inside, np.where(inside, base, 0.0), p, ~inside)]
                part = slice(texts.first, texts.first + texts.count)
                yield table(main_schema, batch.column(0)[part], text_hashes(texts), np.diff(bounds), sums[0].astype(int), sums[1], sums[2], sums[3].astype(int))

    def rest(batches):
        head, _ = spread.value
        for batch in batches:
            for texts in text_slices(batch.column(1)):
                tokens, bounds = tokens_of(texts)
                at = np.flatnonzero(head.of(tokens) < 0)
                owner = np.repeat(np.arange(texts.count), np.diff(bounds))[at]
                order = np.lexsort((tokens[at], owner))
                owner, token = owner[order], tokens[at][order]
                new = np.ones(len(token), dtype=bool)
                new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(token)))
                ids = batch.column(0)[texts.first : texts.first + texts.count].take(pa.array(owner[first]))
                yield table(tail_schema, ids, text_hashes(texts)[owner[first]], token[first], times)

    known = counts.withColumnRenamed("count", "c")
    found = rows.mapInArrow(rest, tail).join(known, "token", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    base, share = _logs(head, model, F.col("c"), F.log10)
    times = F.col("times")
    sums = {"tail_known": F.when(F.col("c") > 0, times).otherwise(0), "tail_base": times * base, "tail_share": times * share, "tail_seen": times}
    found = found.groupBy("doc_id", "text_hash").agg(*(F.sum(x).alias(name) for name, x in sums.items()))
    same = F.col("doc_id").eqNullSafe(F.col("tail_id")) & (F.col("text_hash") == F.col("tail_hash"))
    out = rows.mapInArrow(run, main).join(found.withColumnsRenamed({"doc_id": "tail_id", "text_hash": "tail_hash"}), same, "left")
    # rows that repeat a document put its tail together: each has its share of the sums
    part = F.when(F.col("n_tail") > 0, F.col("n_tail") / F.col("tail_seen")).otherwise(0.0)
    more = {name: F.coalesce(F.col(name) * part, F.lit(0.0)) for name in sums}
    return out.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.round(more["tail_known"]).cast("long")).alias("n_known"),
        (F.col("base_score") + more["tail_base"]).alias("base_score"), (F.col("score") + more["tail_share"]).alias("score"),
    )


def score_all(docs: DataFrame, training: DataFrame, classes: int = CLASSES) -> tuple[DataFrame, int]:
    """Scores of docs by a model of the texts of ``training``; and the number of training tokens."""
    counts = saved(count_tokens(training))
    head = head_counts(counts)
    return score(docs, counts, head, train(training, head, classes)), head.total
