"""Token alignment against a plain version, one text and one token at a time."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest
import sentencepiece
import tokenizers
from conftest import ODD, SCHEMA, prose

from albumflow.llm import token_alignment as ta

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
TEXTS = [
    "Hello, world!  Two  spaces\n\nand\ttabs", "été ñandú 漢字 \U0001f600 \U0001f600", "ignore <|endoftext|> and </s><s>", "a ▁ b", "▁", " ", "\n", "x", "don't  we'll",
    "word " * 300, "0123456789" * 30, "<0x41>", "naïve café", "\u0000 nul", "é combining", " nbsp",
]


@pytest.fixture(scope="module")
def plain():
    a = tokenizers.Tokenizer.from_file(ta.BYTE_BPE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=ta.PIECE_BPE)
    letters = ta._byte_letters()

    def piece(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def both(text):
        left = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids] if text else []
        right = [(i, piece(i)) for i in b.encode(text)] if text else []
        whole = (" " + (text or "")).encode()
        return (left, right) if b"".join(x for _, x in left) == b"".join(x for _, x in right) == whole else ([], [])

    return both


def spans(tokens):
    at, out = 0, []
    for i, raw in tokens:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def by_hand(rows, both):
    work, counts = [], Counter()
    for doc_id, text in rows:
        a, b = map(spans, both(text))
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups = [([i for i, s, e in a if low <= s and e <= high], [i for i, s, e in b if low <= s and e <= high]) for low, high in zip([0, *cuts], cuts, strict=False)]
        pairs = [(i, j) for i, s, e in a for j, t, f in b if max(s, t) < min(e, f)] if len(a) < 700 else linked(a, b)
        counts.update(pairs)
        work.append((doc_id, a, b, groups, pairs))
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    out = []
    for doc_id, a, b, groups, pairs in work:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if a else ""
        out.append((doc_id, len(a), len(b), len(groups), len(pairs), sum(counts[p] == best[p[1]] for p in pairs), sum(counts[p] for p in pairs), digest))
    return sorted(out, key=str)


def linked(a, b):
    out, at = [], 0
    for i, s, e in a:
        while at < len(b) and b[at][2] <= s:
            at += 1
        k = at
        while k < len(b) and b[k][1] < e:
            out.append((i, b[k][0]))
            k += 1
    return out


def collected(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("head", [1 << 18, 0, 40])
def test_links(spark, plain, monkeypatch, head):
    monkeypatch.setattr(ta, "HEAD", head)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, prose(i, 60)) for i in range(12)] + [(3, "a ▁ b"), (7, "x"), (None, "x y"), (200, None), (201, "")]
    docs = spark.createDataFrame([(*r, "en", "a", 1) for r in rows], SCHEMA).repartition(3)
    assert collected(ta.links(docs)) == by_hand(rows, plain)


def test_long_texts_and_clashing_columns(spark, clashing, plain):
    keep = clashing.where("doc_id is null or doc_id <> 8")
    assert collected(ta.links(keep)) == by_hand([r[:2] for r in ODD if r[0] != 8], plain)


def test_texts_that_the_fast_engine_cannot_split():
    a = ta.ByteTokenizer(ta.BYTE_BPE)
    text = " " * 1_000_000 + "a"
    assert a._fast is not None and b"".join(a.tokens[i] for i in a.encode(text).tolist()) == text.encode()


def test_fast_engine_equals_the_file(spark, docs, plain):
    a = ta.ByteTokenizer(ta.BYTE_BPE)
    for r in docs.limit(60).collect():
        assert a.encode(" " + r.text).tolist() == a._whole.encode(" " + r.text, add_special_tokens=False).ids


def test_empty(spark, empty):
    assert ta.links(empty).count() == 0
