"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed tokens over all documents give the TF-IDF weights.
2. Benchmark passages (items, cut at ``PASSAGE`` tokens) form a TF-IDF matrix of rows of length 1; Spark tasks
   sketch it with random vectors, and a Nystrom step on the bounded sketch gives its leading
   singular vectors: the latent space.  It is fitted to the benchmark because those
   are the directions to be found; every window of every document is projected to it.
   A space serves about ``ITEMS`` passages and is truncated to ``RANK`` directions, or half as many as it has passages.
3. A passage of up to 8, 16, 32 or 64 tokens (``LENGTHS``) is sought in windows of three times that
   length, one such length apart, so any text of twice the length lies whole in a window.  A window is a
   candidate for the passages whose cosine with it in the latent space is at least ``COSINE``; nothing else chooses
   candidates.  Windows with too little weight on benchmark tokens for any passage at all are not projected.
   The search is approximate: what it loses against all pairs of windows and passages is measured, not ruled out.
4. A candidate counts if the longest common subsequence with the window covers
   ``COMMON`` of the passage's tokens, and ``ANSWER`` of the weight of the passage's last quarter (its
   answer) occurs there.  So changed, missing or added words are tolerated.
5. Items of fewer than ``SHORTEST`` tokens match where exactly these tokens follow one another.

The benchmark's passages are dealt to spaces, and about ``ITEMS`` of them are searched in one pass
over the documents, so that what is broadcast is bounded.
Tokens are runs of digits, letters and characters outside ASCII, lower-cased.

Edge cases: null and empty texts, and items without any token, match nothing; repeated documents and items each match; an empty table gives an empty
result, an empty benchmark drops nothing.  Other columns are not read by ``matches``;
``drop_contaminated`` returns all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumflow.llm.kernels import MARKS, U64, shingle_hashes, split_words, table, text_slices, word_hashes
from albumflow.llm.shared import arrow_schema, saved

TERMS = 1 << 18
RANK = 128
OVER = 16  # further random vectors of the sketch
COSINE = 0.35
PASSAGE = 64
LENGTHS = (8, 16, 32, 64)
SHORTEST = 8
ITEMS = 1024
COMMON = 0.6
ANSWER = 0.5


class Index(NamedTuple):
    """The passages of one latent space."""

    weights: np.ndarray  # inverse document frequency of each term
    known: np.ndarray  # term -> row of ``basis``, or -1
    basis: np.ndarray  # (benchmark terms, rank)
    latent: np.ndarray  # (passages, rank), of length 1
    items: np.ndarray  # item_id of each passage
    tokens: list[np.ndarray]


def token_slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, number of rows, tokens and their bounds by row, of each slice of a column."""
    for part in text_slices(pc.utf8_lower(pc.fill_null(texts, ""))):
        words = split_words(part, MARKS)
        yield part.first, part.count, word_hashes(part, words, fold=True), words.bounds


def _terms(tokens: np.ndarray) -> np.ndarray:
    return (tokens % U64(TERMS)).astype(np.int64)


def term_weights(docs: DataFrame) -> np.ndarray:
    """Inverse document frequencies over all texts."""
    schema = arrow_schema("term int, df bigint")

    def run(batches):
        df = np.zeros(TERMS, dtype=np.int64)
        for batch in batches:
            for _, count, tokens, bounds in token_slices(batch.column(0)):
                row = np.repeat(np.arange(count), np.diff(bounds))
                df += np.bincount(np.unique(row * TERMS + _terms(tokens)) % TERMS, minlength=TERMS)
        at = np.flatnonzero(df)
        yield table(schema, at, df[at])

    counted = docs.select("text").mapInArrow(run, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(TERMS)
    df[counted.column("term").to_numpy()] = counted.column("df").to_numpy()
    return np.log1p(max(docs.count(), 1) / (df + 1)).astype(np.float32)


def cut_passages(benchmark: DataFrame) -> DataFrame:
    """(item_id, tokens) of every distinct passage of the benchmark (item_id, text)."""
    schema = arrow_schema("item_id bigint, tokens binary")

    def run(batches):
        for batch in batches:
            for first, count, tokens, bounds in token_slices(batch.column(1)):
                rows, out = [], []
                for i in range(count):
                    own = tokens[bounds[i] : bounds[i + 1]]
                    for at in range(0, max(1, len(own) - PASSAGE // 2), PASSAGE // 2):
                        piece = own[at : at + PASSAGE]
                        if len(piece):
                            rows.append(first + i)
                            out.append(piece.tobytes())
                yield table(schema, batch.column(0).take(pa.array(rows, pa.int64())), out)

    return benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(run, "item_id bigint, tokens binary").distinct()


def _tokens(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, U64) for x in column.to_pylist()]


def _rows(passages: list[np.ndarray], weights: np.ndarray, known: np.ndarray) -> np.ndarray:
    """TF-IDF rows over the benchmark's terms, of length 1."""
    out = np.zeros((len(passages), int(known.max()) + 1), dtype=np.float32)
    for row, tokens in zip(out, passages, strict=True):
        term = _terms(tokens)
        np.add.at(row, known[term], weights[term])
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _latent_basis(block: DataFrame, count: int, weights: np.ndarray, known: np.ndarray, seed: int = 3) -> np.ndarray:
    """The leading right singular vectors of the block's TF-IDF matrix, from one distributed pass.

    Each task adds up G = A'(A R) over its passages, R being random; G and R give the
    Nystrom approximation of A'A.
    """
    rank = min(RANK, max(1, count // 2))
    size, wide = int(known.max()) + 1, min(rank + OVER, count, int(known.max()) + 1)
    random = np.random.default_rng(seed).normal(size=(size, wide)).astype(np.float32)
    spread = block.sparkSession.sparkContext.broadcast((weights, known, random))
    schema = arrow_schema("part int, data binary")
    step = 1024

    def run(batches):
        weights, known, random = spread.value
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = _rows(_tokens(batch.column(0).slice(at, 64)), weights, known)
                sketch = rows.T @ (rows @ random)
                total = sketch if total is None else total + sketch
        if total is not None:
            for part, at in enumerate(range(0, size, step)):
                yield table(schema, [part], [total[at : at + step].tobytes()])

    sketch = np.zeros((size, wide), dtype=np.float64)
    for row in block.select("tokens").mapInArrow(run, "part int, data binary").toLocalIterator():
        at = row.part * step
        piece = np.frombuffer(row.data, np.float32).reshape(-1, wide)
        sketch[at : at + len(piece)] += piece
    # A'A is about G (R'G)^-1 G'; its eigenvectors come from a thin factor of G.
    core = random.T @ sketch
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > values.max() * 1e-7
    u, s, _ = np.linalg.svd(sketch @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    return u[:, s > s.max() * 1e-4][:, :rank].astype(np.float32)


def indexes(benchmark: DataFrame, weights: np.ndarray) -> Iterator[list[Index]]:
    """The benchmark (item_id, text) in latent spaces of about ``ITEMS`` passages, one searched at a time."""
    rows = cut_passages(benchmark)
    rows = saved(rows.withColumn("hash", F.xxhash64("item_id", "tokens")))
    count = rows.count()
    blocks = -(-count // ITEMS)
    numbered = rows.withColumn("block", F.pmod("hash", F.lit(max(1, blocks))))
    for i in range(blocks):
        block = numbered.where(F.col("block") == i).select("item_id", "tokens")
        own = block.toArrow()
        if own.num_rows:
            passages = _tokens(own.column("tokens"))
            terms = np.unique(_terms(np.concatenate(passages)))
            known = np.full(TERMS, -1, dtype=np.int32)
            known[terms] = np.arange(len(terms))
            basis = _latent_basis(block, len(passages), weights, known)
            latent = np.vstack([_rows(passages[at : at + 64], weights, known) @ basis for at in range(0, len(passages), 64)])
            latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
            ids = own.column("item_id").fill_null(-1).to_numpy()
            yield [Index(weights, known, basis, latent, ids, passages)]


def _needed(length: int) -> int:
    """The fewest tokens of a passage that are ``COMMON`` of it."""
    return next(n for n in range(length + 1) if n / length >= COMMON)


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a row of bits at a time."""
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _covers(index: Index, passage: int, near: np.ndarray) -> tuple[float, float]:
    """Shares of a passage in the tokens near a window: common subsequence, and answer weight."""
    own = index.tokens[passage]
    answer = own[-max(1, len(own) // 4) :]
    weight = index.weights[_terms(answer)]
    there = set(near.tolist())
    found = float(weight[[x in there for x in answer.tolist()]].sum() / weight.sum())
    return (common_subsequence(own, near) / len(own) if found >= ANSWER else 0.0), found


def search(group: list[Index], texts: pa.Array) -> Iterator[tuple[int, int, float, float, float]]:
    """Row, item_id, cosine, common share and answer share of every match in a column of texts."""
    for first, count, tokens, bounds in token_slices(texts):
        for index in group:
            for row, *found in _search(index, tokens, bounds):
                yield first + row, *found


def _exact(index: Index, tokens: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, float, float, float]]:
    """Matches of the items of fewer than ``SHORTEST`` tokens."""
    size = np.array([len(x) for x in index.tokens])
    for length in np.unique(size[size < SHORTEST]).tolist():
        passages = np.flatnonzero(size == length)
        own = np.array([shingle_hashes(index.tokens[p], length)[0] for p in passages])
        grams = shingle_hashes(tokens, length)
        at = np.flatnonzero(np.isin(grams, own))
        row = np.searchsorted(bounds, at, side="right") - 1
        inside = at + length <= bounds[row + 1]
        for i, k in set(zip(row[inside].tolist(), grams[at[inside]].tolist(), strict=True)):
            for passage in passages[own == U64(k)]:
                yield i, int(index.items[passage]), 1.0, 1.0, 1.0


def _search(index: Index, tokens: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, float, float, float]]:
    yield from _exact(index, tokens, bounds)
    reach = np.array([len(x) for x in index.tokens])
    least = np.zeros(len(reach))  # weight of the lightest tokens that would do
    for p, own in enumerate(index.tokens):
        weight = np.sort(index.weights[_terms(own)].astype(np.float64) ** 2)
        least[p] = weight[: _needed(len(own))].sum()
    count, term = len(bounds) - 1, _terms(tokens)
    number = index.known[term]
    weight = index.weights[term].astype(np.float64)
    inside = np.append(0.0, np.cumsum(np.where(number >= 0, weight * weight, 0.0)))
    kept = np.append(0, np.cumsum(number >= 0))
    size = np.diff(bounds)
    for shorter, length in zip((SHORTEST - 1, *LENGTHS), LENGTHS, strict=False):
        passages = np.flatnonzero((reach > shorter) & (reach <= length))
        if not len(passages):
            continue
        width = 3 * length
        windows = np.where(size > 0, 1 + np.maximum(0, -(-(size - width) // length)), 0)
        row = np.repeat(np.arange(count), windows)
        place = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
        start = bounds[row] + place * length
        end = np.minimum(start + width, bounds[row + 1])
        fewest = min(_needed(int(n)) for n in reach[passages])
        enough = least[passages].min() * (1 - 1e-6) - 1e-6
        able = np.flatnonzero((kept[end] - kept[start] >= fewest) & (inside[end] - inside[start] >= enough))
        rows, needed, answers = _outline(index, passages, length)
        for i in range(0, len(able), 512):
            at = able[i : i + 512]
            window = _Windows(index, number, weight, start[at], end[at], width)
            chosen, which, cosine = window.near(passages)
            there = window.has(chosen, rows[which])  # only what the rule can accept is compared in full
            fit = (there.sum(axis=1) >= needed[which]) & ((there * answers[which]).sum(axis=1) >= ANSWER - 1e-5)
            for w, p, c in zip(chosen[fit].tolist(), which[fit].tolist(), cosine[fit].tolist(), strict=True):
                k, passage = at[w], passages[p]
                common, answer = _covers(index, passage, tokens[start[k] : end[k]])
                if common >= COMMON and answer >= ANSWER:
                    yield int(row[k]), int(index.items[passage]), c, common, answer


def _outline(index: Index, passages: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each passage: the basis rows of its tokens (one past the last for none), how many of them a match needs, and each token's share of the answer's weight."""
    rows = np.full((len(passages), length), len(index.basis), dtype=np.int64)
    answers = np.zeros((len(passages), length), dtype=np.float32)
    for i, p in enumerate(passages):
        term = _terms(index.tokens[p])
        rows[i, : len(term)] = index.known[term]
        tail = max(1, len(term) // 4)
        weight = index.weights[term[-tail:]]
        answers[i, len(term) - tail : len(term)] = weight / weight.sum()
    return rows, np.array([_needed(len(index.tokens[p])) for p in passages]), answers


class _Windows:
    """Some windows: which benchmark terms each has, with what weight.

    ``number`` and ``weight`` are the rows of the basis and the weights of all tokens; a window counts each of its terms once.
    """

    def __init__(self, index: Index, number: np.ndarray, weight: np.ndarray, start: np.ndarray, end: np.ndarray, width: int):
        span = start[:, None] + np.arange(width)
        used = np.minimum(span, len(number) - 1)
        here = np.where(span < end[:, None], number[used], -1)
        which, column = np.nonzero(here >= 0)
        rows = here[which, column]
        occurs = np.zeros(len(index.basis) + 1, dtype=bool)
        occurs[rows] = True
        terms = np.flatnonzero(occurs)
        self._place = np.where(occurs, np.cumsum(occurs) - 1, len(terms))  # the last column is empty
        self._present = np.zeros((len(start), len(terms) + 1), dtype=np.float32)
        self._present[which, self._place[rows]] = weight[used[which, column]]
        self._index, self._terms = index, terms

    def near(self, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows, passages (places in ``passages``) and cosines of all pairs that are near in the latent space."""
        vectors = self._present[:, :-1] @ self._index.basis[self._terms]
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
        cosine = vectors @ self._index.latent[passages].T
        w, p = np.nonzero(cosine >= COSINE)
        return w, p, cosine[w, p]

    def has(self, windows: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Whether each window has the terms of each list of basis rows."""
        return self._present[windows[:, None], self._place[rows]] > 0


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, common, answer: the best match of each document and item."""
    ddl = "doc_id bigint, item_id bigint, cosine double, common double, answer double"
    schema = arrow_schema(ddl)
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    out = spark.createDataFrame([], ddl)
    for group in indexes(benchmark, term_weights(docs)):
        spread = spark.sparkContext.broadcast(group)

        def run(batches, spread=spread):
            for batch in batches:
                found = list(search(spread.value, batch.column(1)))
                row, *columns = zip(*found, strict=True) if found else [()] * 5
                yield table(schema, batch.column(0).take(pa.array(row, pa.int64())), *columns)

        out = out.unionByName(rows.mapInArrow(run, ddl))
    best = F.max(F.struct("common", "cosine", "answer")).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.cosine", "best.common", "best.answer")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of docs, all columns, that match no benchmark item."""
    spark, at = docs.sparkSession, docs.columns.index("text")
    out = docs
    for group in indexes(benchmark, term_weights(docs)):
        spread = spark.sparkContext.broadcast(group)

        def run(batches, spread=spread):
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                clean[[m[0] for m in search(spread.value, batch.column(at))]] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(run, docs.schema)
    return out
