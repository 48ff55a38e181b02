"""Alignment of two tokenizers' tokens over the same bytes, with an identity-map fast path.

1. Every text is encoded by a byte-level BPE (A) and by a piece model (B).  Byte offsets where tokens
   of both end cut them into groups; within a group, each stretch between two ends of either side links the
   A token and the B token that cover it, so links are exactly the pairs whose byte ranges overlap.
2. A map from each A id to the B id of the same bytes is computed once.  Links that follow it (groups
   of one token each, save for rare cases) are counted in vectors as long as A's vocabulary,
   which tasks add up; no such link is shuffled.  All other links enter the shuffle of pairs.
3. Encodings are made once: a table of one row a document holds its counts, the hash of its
   groups and its distinct links.  The second pass reads that table only.
4. To look up counts, the identity vector, each B id's highest count and the most frequent other pairs
   (``HEAD`` at most) are broadcast: sizes bounded by the vocabularies and a constant.  Links
   with rarer pairs are joined with the pair table, where no pair is frequent enough to
   fill a task.

Edge cases: null and empty texts, and texts that either tokenizer changes (a U+2581 in the text,
say), have no tokens and zeros; rows that repeat a doc_id or text each have a row and count each; special tokens' strings
are plain text; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumflow.llm.kernels import Texts, table, text_slices
from albumflow.llm.shared import arrow_schema, saved

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
HEAD = 1 << 18
#: The byte-level pre-tokenizer's pattern (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Vocabulary(NamedTuple):
    """Bytes of all tokens, one after the other, and each id's range in them."""

    data: np.ndarray
    start: np.ndarray
    size: np.ndarray


def _vocabulary(tokens: list[bytes]) -> Vocabulary:
    size = np.array([len(t) for t in tokens])
    return Vocabulary(np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size, size)


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of byte-level tokens stands for: printable ones stand for themselves, others for letters from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(other)}


class ByteTokenizer:
    """Byte-level BPE read from a ``tokenizers`` file.

    Where every merge's rank is also its token's id, the much faster ``tiktoken`` gives the same ids;
    texts that its regex engine cannot split (a million blanks) go to ``tokenizers``.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocab, added = model["model"]["vocab"], {t["content"]: t["id"] for t in model["added_tokens"]}
        letters = _byte_letters()
        self.tokens = [b""] * (1 + max(*vocab.values(), *added.values()))
        for token, i in vocab.items():
            self.tokens[i] = bytes(letters[c] for c in token)
        for token, i in added.items():
            self.tokens[i] = token.encode()
        self._whole = tokenizers.Tokenizer.from_file(path)
        self._whole.encode_special_tokens = True
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["model"]["merges"]]
        ranked = [vocab[m] for m in merges] == list(range(256, 256 + len(merges))) and len(vocab) == 256 + len(merges)
        ranked = ranked and model["normalizer"] is None and model["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        ranks = {self.tokens[i]: i for i in vocab.values()}
        self._fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranked else None

    def encode(self, text: str) -> np.ndarray:
        if self._fast is not None:
            try:
                return self._fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
            except ValueError:
                pass
        return np.array(self._whole.encode(text, add_special_tokens=False).ids, dtype=np.int64)


class PieceTokenizer:
    """A ``sentencepiece`` model, which puts a space before each text."""

    def __init__(self, path: str):
        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self._model.get_piece_size())
        pieces = [self._model.id_to_piece(i) for i in ids]
        self.tokens = [bytes([int(p[3:5], 16)]) if self._model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, pieces, strict=True)]

    def encode(self, text: str) -> np.ndarray:
        return np.array(self._model.encode(text, num_threads=1), dtype=np.int64)


class Pair(NamedTuple):
    a: ByteTokenizer
    b: PieceTokenizer
    bytes_a: Vocabulary
    bytes_b: Vocabulary
    same: np.ndarray  # the B id of the same bytes, or -1, of every A id


@cache
def load(byte_bpe: str, piece_bpe: str) -> Pair:
    """Both tokenizers, once a process."""
    a, b = ByteTokenizer(byte_bpe), PieceTokenizer(piece_bpe)
    by_bytes: dict[bytes, int] = {}
    for i in reversed(range(len(b.tokens))):  # of several B ids of the same bytes, the last, as byte tokens come first
        by_bytes.setdefault(b.tokens[i], i)
    same = np.array([by_bytes.get(t, -1) for t in a.tokens])
    return Pair(a, b, _vocabulary(a.tokens), _vocabulary(b.tokens), same)


def _spell(ids: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """The tokens' bytes, joined."""
    size = vocabulary.size[ids]
    shift = vocabulary.start[ids] - (np.cumsum(size) - size)
    return vocabulary.data[np.repeat(shift, size) + np.arange(int(size.sum()))]


class Aligned(NamedTuple):
    """Tokens, groups and links of the texts of a slice that both tokenizers keep."""

    a: np.ndarray
    b: np.ndarray
    row_a: np.ndarray  # text of each token
    row_b: np.ndarray
    group_a: np.ndarray  # group of each token
    group_b: np.ndarray
    row_group: np.ndarray  # text of each group
    link_a: np.ndarray  # tokens of each link
    link_b: np.ndarray


def align(texts: Texts, pair: Pair) -> Aligned:
    """Both token sequences of every text, cut into groups and linked."""
    none = np.zeros(0, np.int64)
    ids: tuple[list, list] = ([], [])
    rows = []
    for i in range(texts.count):
        raw = texts.data[texts.bounds[i] : texts.bounds[i + 1]].tobytes()
        if not raw:
            continue
        text = raw.decode()
        both = pair.a.encode(" " + text), pair.b.encode(text)
        raw = b" " + raw
        if all(_spell(x, v).tobytes() == raw for x, v in zip(both, (pair.bytes_a, pair.bytes_b), strict=True)):
            rows.append(i)
            for held, x in zip(ids, both, strict=True):
                held.append(x)
    if not rows:
        return Aligned(*[none] * 9)
    a, b = np.concatenate(ids[0]), np.concatenate(ids[1])
    row_a, row_b = (np.repeat(rows, [len(x) for x in held]) for held in ids)
    end_a, end_b = np.cumsum(pair.bytes_a.size[a]), np.cumsum(pair.bytes_b.size[b])
    ends = np.union1d(end_a, end_b)
    common = np.intersect1d(end_a, end_b, assume_unique=True)
    link_a, link_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
    return Aligned(a, b, row_a, row_b, np.searchsorted(common, end_a), np.searchsorted(common, end_b), row_a[np.searchsorted(end_a, common)], link_a, link_b)


@cache
def _decimals(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Digits of all ids, left aligned with room for a mark, and their number."""
    width = len(str(count)) + 1
    text = np.array([str(i).ljust(width) for i in range(count)], dtype=f"S{width}")
    return text.view(np.uint8).reshape(count, width), np.array([len(str(i)) for i in range(count)])


def written_groups(x: Aligned, pair: Pair) -> tuple[np.ndarray, np.ndarray]:
    """The groups of all texts as text (``a1,a2|b1;a3|b2``), and the row of each byte."""
    groups = len(x.row_group)
    in_a, in_b = np.bincount(x.group_a, minlength=groups), np.bincount(x.group_b, minlength=groups)
    n = len(x.a) + len(x.b)
    token, row, mark = np.empty(n, np.int64), np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
    place_a = np.arange(len(x.a)) + (np.cumsum(in_b) - in_b)[x.group_a]
    place_b = np.arange(len(x.b)) + np.cumsum(in_a)[x.group_b]
    for place, ids, rows in ((place_a, x.a, x.row_a), (place_b, x.b, x.row_b)):
        token[place], row[place] = ids, rows
    last_b = np.cumsum(in_a + in_b) - 1
    mark[last_b - in_b] = ord("|")
    mark[last_b] = np.where(np.append(x.row_group[1:] != x.row_group[:-1], True), 0, ord(";"))
    digits, size = _decimals(max(len(pair.bytes_a.size), len(pair.bytes_b.size)))
    out, length = digits[token], size[token]
    out[np.arange(n), length] = mark
    length = length + (mark > 0)
    kept = np.arange(out.shape[1]) < length[:, None]
    return out[kept], np.repeat(row, length)


_ENCODED = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string,"
    " identity binary, identity_times binary, other binary, other_times binary"
)


def _packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of values as binaries."""
    wide = np.ascontiguousarray(values)
    raw = wide.tobytes()
    size = wide.itemsize
    return pa.array([raw[size * i : size * j] for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.binary())


def _unpacked(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of binaries, and their number by row."""
    values = column.to_pylist()
    size = np.array([len(v) for v in values], dtype=np.int64) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(values), kind), size


def _runs(row: np.ndarray, value: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of each row, how often each occurs, and the bounds of rows."""
    bits = max(1, int(value.max(initial=0)).bit_length())
    both, times = np.unique((row << bits) | value, return_counts=True)
    return both & ((1 << bits) - 1), times, np.searchsorted(both >> bits, np.arange(count + 1))


def encode(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """One row a document: its counts, the hash of its groups, and its distinct links.

    ``identity`` holds the A ids of links that follow the identity map, ``other`` the codes (A id times
    B's vocabulary, plus B id) of all others.
    """
    schema = arrow_schema(_ENCODED)

    def run(batches):
        pair = load(byte_bpe, piece_bpe)
        many = len(pair.bytes_b.size)
        for batch in batches:
            for texts in text_slices(batch.column(1)):
                x = align(texts, pair)
                n = texts.count
                letters, row = written_groups(x, pair)
                letters, ends = letters.tobytes(), np.searchsorted(row, np.arange(n + 1))
                hashes = [hashlib.sha256(letters[i:j]).hexdigest() if j > i else "" for i, j in zip(ends[:-1], ends[1:], strict=True)]
                a, b, link_row = x.a[x.link_a], x.b[x.link_b], x.row_a[x.link_a]
                same = pair.same[a] == b
                one = _runs(link_row[same], a[same], n)
                other = _runs(link_row[~same], a[~same] * many + b[~same], n)
                counts = (np.bincount(r, minlength=n) for r in (x.row_a, x.row_b, x.row_group, link_row))
                columns = (_packed(one[0].astype(np.int32), one[2]), _packed(one[1].astype(np.int32), one[2]), _packed(other[0], other[2]), _packed(other[1].astype(np.int32), other[2]))
                yield table(schema, batch.column(0)[texts.first : texts.first + n], *counts, hashes, *columns)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _ENCODED)


def identity_counts(encoded: DataFrame, size: int) -> np.ndarray:
    """How often each A id is linked with the B id of the same bytes."""
    schema = arrow_schema("id int, count bigint")

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            np.add.at(total, _unpacked(batch.column(0), np.int32)[0], _unpacked(batch.column(1), np.int32)[0])
        at = np.flatnonzero(total)
        yield table(schema, at, total[at])

    rows = encoded.select("identity", "identity_times").mapInArrow(run, "id int, count bigint").groupBy("id").agg(F.sum("count").alias("count")).toArrow()
    out = np.zeros(size, np.int64)
    out[rows.column("id").to_numpy()] = rows.column("count").to_numpy()
    return out


def pair_counts(encoded: DataFrame) -> DataFrame:
    """(code, count) of all links outside the identity map."""
    ddl = "code bigint, count bigint"
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            codes, times = (_unpacked(batch.column(i), kind)[0] for i, kind in ((0, np.int64), (1, np.int32)))
            own, place = np.unique(codes, return_inverse=True)
            yield table(schema, own, np.bincount(place, times, minlength=len(own)).astype(np.int64))

    return encoded.select("other", "other_times").mapInArrow(run, ddl).groupBy("code").agg(F.sum("count").alias("count"))


class Counts(NamedTuple):
    """Counts of pairs that all tasks hold."""

    identity: np.ndarray  # by A id
    identity_best: np.ndarray  # whether it is its B id's highest
    codes: np.ndarray  # the most frequent other pairs, sorted
    counts: np.ndarray
    best: np.ndarray


def _most_frequent(pairs: DataFrame) -> DataFrame:
    """The pairs of the highest counts, at most ``HEAD``: a histogram on a logarithmic scale tells from which count on."""
    step = F.floor(F.log2("count") * 16)
    least, room = None, HEAD
    for r in sorted(pairs.groupBy(step.alias("step")).agg(F.count("*").alias("pairs")).collect(), key=lambda r: -r.step):
        room -= r.pairs
        if room < 0:
            break
        least = r.step
    return pairs.where(step >= least if least is not None else F.lit(False))


def links(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of docs."""
    spark = docs.sparkSession
    pair = load(byte_bpe, piece_bpe)
    many, same = len(pair.bytes_b.size), pair.same
    encoded = saved(encode(docs, byte_bpe, piece_bpe).withColumn("row", F.monotonically_increasing_id()))
    identity = identity_counts(encoded, len(same))
    pairs = saved(pair_counts(encoded))
    highest = np.zeros(many, np.int64)
    known = np.flatnonzero((same >= 0) & (identity > 0))
    np.maximum.at(highest, same[known], identity[known])
    b_of = F.pmod("code", F.lit(many))
    others = pairs.groupBy(b_of.cast("int").alias("b")).agg(F.max("count").alias("count")).toArrow()
    np.maximum.at(highest, others.column("b").to_numpy(), others.column("count").to_numpy())
    head = _most_frequent(pairs).toArrow().sort_by("code")
    codes, counts = head.column("code").to_numpy(), head.column("count").to_numpy()
    held = Counts(identity, identity == np.where(same >= 0, highest[same], -1), codes, counts, counts == highest[codes % many])
    spread = spark.sparkContext.broadcast(held)

    ddl = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, best bigint, total bigint, n_rare bigint"
    schema, rare_ddl = arrow_schema(ddl), "row bigint, code bigint, times bigint"
    rare_schema = arrow_schema(rare_ddl)

    def found(held: Counts, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place among the most frequent pairs, and whether there is one."""
        if not len(held.codes):
            return np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
        at = np.minimum(np.searchsorted(held.codes, codes), len(held.codes) - 1)
        return at, held.codes[at] == codes

    def sums(rows: np.ndarray, *values: np.ndarray, n: int) -> list[np.ndarray]:
        """Exact sums of whole numbers by row, rows being in order."""
        ends = np.searchsorted(rows, np.arange(n + 1))
        return [np.diff(np.append(0, np.cumsum(v, dtype=np.int64))[ends]) for v in values]

    def common(batches):
        held = spread.value
        for batch in batches:
            n = batch.num_rows
            ids, size = _unpacked(batch.column(7), np.int32)
            times = _unpacked(batch.column(8), np.int32)[0].astype(np.int64)
            first = sums(np.repeat(np.arange(n), size), times * held.identity_best[ids], times * held.identity[ids], n=n)
            codes, size = _unpacked(batch.column(9), np.int64)
            times = _unpacked(batch.column(10), np.int32)[0].astype(np.int64)
            at, there = found(held, codes)
            row = np.repeat(np.arange(n), size)
            here = at[there]
            more = sums(row[there], times[there] * held.best[here], times[there] * held.counts[here], n=n)
            (rare,) = sums(row, ~there, n=n)
            yield table(schema, *batch.columns[:7], first[0] + more[0], first[1] + more[1], rare)

    def uncommon(batches):
        held = spread.value
        for batch in batches:
            codes, size = _unpacked(batch.column(1), np.int64)
            times = _unpacked(batch.column(2), np.int32)[0]
            absent = ~found(held, codes)[1]
            rows = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), size)[absent]))
            yield table(rare_schema, rows, codes[absent], times[absent])

    tops = spark.createDataFrame(pa.table({"b": np.arange(many, dtype=np.int32), "highest": highest}))
    judged = pairs.join(F.broadcast(tops), b_of.cast("int") == F.col("b")).select("code", "count", (F.col("count") == F.col("highest")).alias("best"))
    rare = encoded.select("row", "other", "other_times").mapInArrow(uncommon, rare_ddl).join(judged, "code")
    rare = rare.groupBy(F.col("row").alias("rare_row")).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("count")).alias("more"))
    rows = encoded.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "identity", "identity_times", "other", "other_times").mapInArrow(common, ddl)
    out = rows.join(rare, (F.col("row") == F.col("rare_row")) & (F.col("n_rare") > 0), "left")
    whole = {"n_best": F.col("best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("total") + F.coalesce("more", F.lit(0))}
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *(x.cast("long").alias(name) for name, x in whole.items()), "groups_sha256")
