"""Language identification, quality, and language-model scoring."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import SCHEMA
from pyspark.sql import functions as F

from albumflow.llm import language, lm_scoring, quality
from albumflow.llm.kernels import text_slices

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def crc(i):
    return zlib.crc32(str(i).encode())


# Language.


@pytest.fixture(scope="module")
def language_model(docs):
    return language.train(docs, docs.where(quality.remainder(4) != 2))


def test_held_out_languages(docs, language_model):
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [(r.lang_pred, truth[r.doc_id]) for r in language.predict(docs, language_model).collect() if crc(r.doc_id) % 4 == 2]
    assert len(held) > 30 and sum(a == b for a, b in held) / len(held) > 0.95


@pytest.mark.parametrize("name", ["odd", "clashing", "empty"])
def test_languages_of_odd_tables(request, language_model, name):
    df = request.getfixturevalue(name)
    got = language.predict(df, language_model).collect()
    assert len(got) == df.count()
    for r in got:
        if r.doc_id in (1, 2, 3):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id is not None:
            assert r.lang_pred in language_model.languages and 0 < r.score <= 1


def test_no_labels_give_no_language(docs):
    model = language.train(docs, docs.where("false"))
    assert {(r.lang_pred, r.score) for r in language.predict(docs, model).collect()} == {("und", 0.0)}


def test_languages_of_short_texts(spark):
    """Five words a text, and a language that only has short ones."""
    rng = random.Random(3)
    words = {"xx": ["ba", "dobo", "gudu", "bubo"], "yy": ["šiš", "čeče", "žiži", "ře"]}
    five = lambda lang: " ".join(rng.choice(words[lang]) for _ in range(5))
    rows = [(i, five("xy"[i % 2] * 2), "xy"[i % 2] * 2, "s", 1) for i in range(200)] + [(300 + i, f"the {i} quick brown foxes " * 30, "zz", "s", 1) for i in range(100)]
    df = spark.createDataFrame(rows, SCHEMA)
    for known in (df.where("doc_id < 200"), df):
        model = language.train(known, known.where("doc_id % 5 <> 0"))
        got = [(r.lang_pred, r.lang) for r in language.predict(known, model).join(known, "doc_id").where("doc_id % 5 = 0").collect()]
        assert np.mean([a == b for a, b in got]) > 0.95
    odd = spark.createDataFrame([(1, None, "xx", "s", 0), (2, "", "yy", "s", 0), (3, "a", None, "s", 0)], SCHEMA)
    assert {(r.lang_pred, r.score) for r in language.predict(odd, language.train(odd, odd)).collect()} == {("und", 0.0)}


def test_pair_tables_give_the_same_as_the_filters(language_model):
    (texts,) = text_slices(pa.array(["Der schnelle Fuchs " * 20, "é" * 300, "x"]))
    row, room, data = language.cut_windows(texts)
    pooled, _ = language._pooled(language_model.filters, data)
    tables = language_model.tables()
    pairs = (data[:, :-1].astype(np.uint16) << 8) | data[:, 1:]
    answers = tables[0][pairs[:, : language.LENGTH]].copy()
    for j, more in enumerate(tables[1:], 1):
        answers[:, :, -more.shape[1] :] += more[pairs[:, 2 * j : 2 * j + language.LENGTH]]
    assert np.allclose(answers.max(axis=1), pooled, atol=1e-4)
    assert room.sum() == len(texts.data) and (np.bincount(row) == -(-np.diff(texts.bounds) // language.LENGTH)).all()


# Quality.


@pytest.fixture(scope="module")
def quality_model(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    many = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return quality.train(many, labels.where(quality.remainder(5) != 0)), many, labels


def test_held_out_quality(quality_model):
    model, many, labels = quality_model
    rows = quality.score(many, model).join(labels, "doc_id").collect()
    held = [(r.score, r.label) for r in rows if crc(r.doc_id) % 5 == 0]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([a > b for a in good for b in bad]) > 0.97
    assert np.mean([(s >= quality.THRESHOLD) == y for s, y in held]) > 0.93


@pytest.mark.parametrize("name", ["odd", "clashing", "empty"])
def test_quality_of_odd_tables(request, quality_model, name):
    model, df = quality_model[0], request.getfixturevalue(name)
    got = quality.score(df, model).collect()
    assert len(got) == df.count() and all(0 <= r.score <= 1 for r in got)
    blank = 1 / (1 + math.exp(-model.bias))
    assert all(r.score == pytest.approx(blank) for r in got if r.doc_id in (1, 2, 3))
    kept = quality.keep_good(df, model)
    assert kept.schema == df.schema
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.score >= quality.THRESHOLD)


def test_no_labels_give_one_half(docs, quality_model):
    model = quality.train(docs, quality_model[2].where("false"))
    assert {r.score for r in quality.score(docs, model).collect()} == {0.5}


def test_training_rows_of_quality_stay_in_tasks(spark, docs, monkeypatch):
    """The driver gets the weights alone, those of a fit to the same rows here."""
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("label")).distinct()
    rows = quality._train_rows(docs, labels, 100).toArrow()
    weights, bias = quality._fitted(rows, quality.EPOCHS)
    monkeypatch.setattr(type(docs), "toArrow", None)
    model = quality.train(docs, labels, 100)
    assert rows.num_rows and (model.weights == weights).all() and model.bias == bias and weights.any()


def test_sparse_scores_are_sums_of_weights(quality_model):
    model = quality_model[0]
    (texts,) = text_slices(pa.array(["a b a", "b", ""]))
    row, number, value = quality.features(texts)
    assert np.bincount(row, minlength=3).tolist() == [3 + 2 + 3 + 2, 2, 0]
    dense = np.zeros((3, quality.DIMENSIONS), np.float32)
    np.add.at(dense, (row, number), value)
    assert np.allclose(dense @ model.weights, np.bincount(row, model.weights[number] * value, minlength=3), atol=1e-4)


# Language-model scores.


def base_by_hand(docs, train):
    tokens = [(i, [*WORD.findall((t or "").encode().lower()), b" "]) for i, t in docs]
    c = Counter(w for i, ws in tokens if train(i) for w in ws)
    n, v = sum(c.values()), len(c)
    log = lambda w: math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1)))
    return Counter((i, len(ws), sum(c[w] > 0 for w in ws), round(sum(map(log, ws)), 6)) for i, ws in tokens), n


@pytest.mark.parametrize(("name", "head"), [("odd", lm_scoring.HEAD), ("clashing", 3), ("docs", 500), ("empty", 10)])
def test_base_scores(request, monkeypatch, name, head):
    monkeypatch.setattr(lm_scoring, "HEAD", head)
    monkeypatch.setattr(lm_scoring, "STEPS", 20)
    df = request.getfixturevalue(name)
    train = df.where("doc_id is not null and doc_id % 3 <> 1")
    got, total = lm_scoring.score_all(df, train)
    want, n = base_by_hand([(r.doc_id, r.text) for r in df.collect()], lambda i: i is not None and i % 3 != 1)
    assert total == n
    rows = got.collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_known) for r in rows) == Counter(k[:3] for k, m in want.items() for _ in range(m))
    ids = [(r.doc_id if r.doc_id is not None else -1, r.base_score) for r in rows]
    hand = [(k[0] if k[0] is not None else -1, k[3]) for k, m in want.items() for _ in range(m)]
    assert [x for _, x in sorted(ids)] == pytest.approx([x for _, x in sorted(hand)], abs=1e-4)


def test_a_word_like_a_known_one_is_unknown(spark):
    one = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, f"x y {one}", None, None, 0), (2, f"x y {other} {one}", None, None, 0), (2, f"x y {one} {one}", None, None, 0)], SCHEMA)
    got, _ = lm_scoring.score_all(df, df.where("doc_id = 1"))
    assert sorted((r.doc_id, r.n_tokens, r.n_known) for r in got.collect()) == [(1, 4, 4), (2, 5, 4), (2, 5, 5)]


def test_no_training_text(docs):
    got, total = lm_scoring.score_all(docs, docs.where("false"))
    assert total == 0 and all(r.n_known == 0 and r.base_score == pytest.approx(0.0) for r in got.collect())


def test_probabilities_add_up(docs):
    counts = lm_scoring.count_tokens(docs)
    head = lm_scoring.head_counts(counts)
    model = lm_scoring.train(docs, head)
    k = len(model.tokens) + 1
    for two, one in ((k, k), (0, 5), (k - 1, 3)):
        p = 10 ** (model.near[one] + model.far[two] - model.normaliser[two, one]).astype(float)
        assert p.sum() == pytest.approx(1, abs=1e-4)
    shared = head.counts[model.classes(head.hashes) == k - 1]
    share = (np.append(shared, 0) + 0.5).sum() / (model.rest_total + 0.5 * (model.rest_distinct + 1))
    assert len(head.hashes) == head.distinct and share == pytest.approx(1)


def test_driver_gets_vectors_only(docs, monkeypatch):
    """What training sends to the driver depends on the number of classes, not on the texts or their contexts."""
    sizes = []
    unpacked = lm_scoring.Network.unpacked
    monkeypatch.setattr(lm_scoring.Network, "unpacked", lambda self, data: sizes.append(len(data)) or unpacked(self, data))
    monkeypatch.setattr(lm_scoring, "STEPS", 40)
    for rows in (docs.where("doc_id % 4 = 0"), docs):
        lm_scoring.train(rows, lm_scoring.head_counts(lm_scoring.count_tokens(rows)), classes=30)
    k = 31
    assert sizes == [2 * (2 * (k + 1) * lm_scoring.WIDTH + k * lm_scoring.WIDTH + k)] * 2 * lm_scoring.ROUNDS
    with pytest.raises(ValueError, match="classes"):
        lm_scoring.train(docs, lm_scoring.head_counts(lm_scoring.count_tokens(docs)), classes=5000)


def test_context_helps_where_it_tells(spark):
    text = "the cat sat on the mat and the dog ran to the cat " * 30
    df = spark.createDataFrame([(i, text, "en", "a", 1) for i in range(12)], SCHEMA)
    got, _ = lm_scoring.score_all(df, df.where("doc_id < 10"))
    r = got.where("doc_id = 11").first()
    assert r.score > 0.7 * r.base_score


def test_contexts_of_all_tokens_of_all_texts(spark, monkeypatch):
    """Counts of contexts against brute force, over more rows and longer texts than any prefix; all may be drawn."""
    rows = [(i, f"a b{i % 7} c {'x ' * (i % 3)}", "en", "a", 1) for i in range(4000)] + [(9000, "the cat " * 2500 + "sat on the mat " * 500, "en", "a", 1), (9001, None, "en", "a", 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    head = lm_scoring.head_counts(lm_scoring.count_tokens(df))
    monkeypatch.setattr(lm_scoring, "STEPS", 400)
    seen = {}
    fit = lm_scoring.fit
    monkeypatch.setattr(lm_scoring, "fit", lambda draws, frequency: seen.update(draws=draws) or fit(draws, frequency))
    model = lm_scoring.train(df, head)
    k = len(model.tokens) + 1
    want = Counter()
    for r in rows:
        tokens, _ = lm_scoring.tokens_of(next(text_slices(pa.array([r[1] or ""]))))
        cls = [k, k, *model.classes(tokens).tolist()]
        want.update(zip(cls, cls[1:], cls[2:]))
    parts = lambda code: (code // (k + 1) ** 2, code // (k + 1) % (k + 1), code % (k + 1))
    assert {parts(r.code): r["count"] for r in lm_scoring.count_contexts(df, model).collect()} == want
    rate = 400 * lm_scoring.BATCH / sum(want.values())
    drawn = Counter({parts(r.code): r.times for r in seen["draws"].collect()})
    assert seen["draws"].rdd.getNumPartitions() == lm_scoring.SHARDS
    assert all(abs(drawn[c] - n * rate) < 1 for c, n in want.items()) and set(drawn) <= set(want)


def test_rare_contexts_are_learned_from(spark, monkeypatch):
    """A context whose share of the training is less than one step has a weight of that share; none is left to chance."""
    monkeypatch.setattr(lm_scoring, "STEPS", 1)
    counts = spark.createDataFrame([(0, 10_000_000)] + [(i, 1) for i in range(1, 400)], "code int, count bigint")
    got = {r.code: r.times for r in lm_scoring.weigh_contexts(counts).collect()}
    rate = lm_scoring.BATCH / 10_000_399
    assert got == pytest.approx({i: (10_000_000 if i == 0 else 1) * rate for i in range(400)})
    codes, weights = lm_scoring.steps_of(np.array(list(got)), np.array(list(got.values())))
    assert set(codes.tolist()) == set(range(400)) and weights.max() <= 1
    assert np.bincount(codes, weights) == pytest.approx([got[i] for i in range(400)], rel=1e-5)


def test_a_weight_counts_as_that_many_steps():
    """A batch with a code twice at half its weight trains as one with it once, and weights bear on the result."""
    noise = np.array([0.5, 0.3, 0.2])
    code = lambda two, one, word: (two * 4 + one) * 4 + word

    def trained(codes, weights):
        net = lm_scoring.new_network(noise, 1)
        lm_scoring.learn(net, np.array(codes, np.int32), np.array(weights, np.float32), noise, np.random.default_rng(2))
        return np.concatenate([p.ravel() for p in net.params])

    a, b = code(3, 0, 1), code(0, 1, 2)
    once = trained([a, b], [1, 0.25])
    assert trained([a, b, a], [0.5, 0.25, 0.5]) == pytest.approx(once)
    assert not np.allclose(trained([a, b], [1, 1]), once)
