"""Importance resampling against the plain formula."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SCHEMA, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from albumflow.llm import resampling

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BENCH = "item_id bigint, text string"


def features(text, ngrams):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
    runs = [" ".join(words[i : i + n]) for n in range(1, ngrams + 1) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10000 for r in runs]


def by_hand(docs, target, percent=10, ngrams=1, seed=2024):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text, ngrams)[1])
    for text in target:
        t.update(features(text, ngrams)[1])
    all_s, all_t = s.total(), t.total()
    rows, able = [], []
    for doc_id, text in docs:
        n, own = features(text, ngrams)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in own]
        weight = sum(gains) // len(gains) if gains else 0
        score = None
        if doc_id is not None:
            h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(own), weight, score, None])
        if n >= 20 and score is not None:
            able.append(rows[-1])
    for i, row in enumerate(sorted(able, key=lambda r: (-r[3], r[0], r[1]))[: percent * len(able) // 100]):
        row[4] = i + 1
    return sorted(map(tuple, rows), key=str)


def collected(df):
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {kind for _, kind in df.dtypes} == {"bigint"}
    return sorted(map(tuple, df.collect()), key=str)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.binary(max_size=90), max_size=30))
def test_crc32(pieces):
    data = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.cumsum([0] + [len(p) for p in pieces])
    assert resampling.crc32(data, ends[:-1], ends[1:]).tolist() == [zlib.crc32(p) for p in pieces]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.lists(st.integers(0, 5000), min_size=100, max_size=100), min_size=1, max_size=4), st.lists(st.integers(-20000, 20000), min_size=100, max_size=100))
def test_sliced_totals(counts, gains):
    counts, gains = np.array(counts), np.array(gains)
    assert (resampling.sliced(gains).totals(counts) == counts @ gains).all()


@pytest.mark.parametrize("ngrams", [1, 2, 3])
@pytest.mark.parametrize("percent", [10, 60, 100])
def test_resample(spark, odd, ngrams, percent):
    target = [None, "", prose(1, 120), "été word word 2 one"]
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    bench = spark.createDataFrame(list(enumerate(target)), BENCH)
    assert collected(resampling.resample(odd, bench, percent=percent, ngrams=ngrams)) == by_hand(rows, target, percent, ngrams)


def test_many_documents_of_one_text(spark):
    rows = [(i, prose(i % 3 + 1, 40)) for i in range(900)]
    docs = spark.createDataFrame([(*r, "en", "a", 1) for r in rows], SCHEMA).repartition(4)
    assert collected(resampling.resample(docs, docs.where("doc_id < 9"))) == by_hand(rows, [t for _, t in rows[:9]])


def test_clashing_and_empty(spark, odd, clashing, empty):
    bench = odd.select("doc_id", "text")
    want = collected(resampling.resample(odd, bench))
    assert collected(resampling.resample(clashing, bench)) == want
    assert resampling.resample(empty, bench).count() == 0
    assert {r.rank for r in resampling.resample(odd, empty, percent=50).collect()} != {None}
