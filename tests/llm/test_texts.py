"""Decontamination, licenses, mixing, and the pipeline."""

from __future__ import annotations

import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import SCHEMA, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from albumflow.llm import decontamination, licenses, mixing, near_dedup, queries

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BENCH = "item_id bigint, text string"


# Decontamination.


def subsequence_by_hand(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        assert decontamination.common_subsequence(np.array(a), np.array(b)) == subsequence_by_hand(a, b)


@pytest.fixture(scope="module")
def planted(spark):
    """Items whole, with words changed, dropped or added, cut in half, and texts of the same words in another order."""
    rng = random.Random(4)
    items = [(i, prose(7000 + i, 24 + i)) for i in range(12)] + [(90, "a b c"), (91, None), (92, "")]
    rows, dirty = [], set()
    for i, text in items[:12]:
        words = text.split()
        changed = [w if rng.random() > 0.15 else f"q{rng.randrange(999)}" for w in words]
        dropped = [w for w in words if rng.random() > 0.15]
        added = [x for w in words for x in ([w, "zz"] if rng.random() < 0.15 else [w])]
        shuffled = rng.sample(words, len(words))
        for kind, body in enumerate((words, changed, dropped, added, words[: len(words) // 3], shuffled)):
            doc = 100 * i + kind
            rows.append((doc, f"{prose(doc, 70)} {' '.join(body).upper()}, {prose(doc + 50, 90)}", "en", "a", 1))
            if kind < 4:
                dirty.add((doc, i))
    return spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(items, BENCH), dirty


def test_matches_of_planted_passages(planted):
    df, bench, dirty = planted
    assert {(r.doc_id, r.item_id) for r in decontamination.matches(df, bench).collect()} == dirty
    clean = {r.doc_id for r in decontamination.drop_contaminated(df, bench).collect()}
    assert clean == {r.doc_id for r in df.collect()} - {d for d, _ in dirty}


def test_blocks_of_the_benchmark(planted, monkeypatch):
    monkeypatch.setattr(decontamination, "ITEMS", 5)
    df, bench, dirty = planted
    assert {(r.doc_id, r.item_id) for r in decontamination.matches(df, bench).collect()} == dirty


def test_verbatim_copies_of_many_items(spark):
    """More passages than one latent space has: each document holds one of 700 items."""
    rng = random.Random(8)
    words = lambda n: [f"w{int(4000 * rng.random() ** 3)}" for _ in range(n)]
    items = [(i, " ".join(words(20 + i % 50))) for i in range(700)]
    rows = [(i, f"{' '.join(words(40))} {text} {' '.join(words(40))}", "en", "a", 1) for i, text in items]
    rows += [(1000 + i, " ".join(words(120)), "en", "a", 1) for i in range(100)]
    want = {(r[0], i) for r in rows for i, text in items if f" {text} " in f" {r[1]} "}
    found = decontamination.matches(spark.createDataFrame(rows, SCHEMA).repartition(4), spark.createDataFrame(items, BENCH))
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert len(want) == 700 and len(want - got) == 0 and {d for d, _ in got} <= {d for d, _ in want}


def all_windows_by_hand(index, text):
    """Items that the rule accepts in any window of the search, every passage tried on every window."""
    out = set()
    for _, _, tokens, bounds in decontamination.token_slices(pa.array([text])):
        own = tokens[bounds[0] : bounds[1]]
        for p, passage in enumerate(index.tokens):
            length = next(n for n in decontamination.LENGTHS if len(passage) <= n)
            for at in range(0, max(1, len(own) - 2 * length), length):
                common, answer = decontamination._covers(index, p, own[at : at + 3 * length])
                if common >= decontamination.COMMON and answer >= decontamination.ANSWER:
                    out.add(int(index.items[p]))
    return out


@pytest.fixture(scope="module")
def paraphrases(spark):
    """300 items in one truncated space, and texts with 5 to 40 of 100 words of an item replaced, dropped or moved apart."""
    rng = random.Random(12)
    word = lambda: f"w{int(3000 * rng.random() ** 3)}"
    items = [(i, [word() for _ in range(rng.randint(9, 64))]) for i in range(300)]
    texts = []
    for _ in range(60):
        _, own = rng.choice(items)
        share = rng.choice([0.05, 0.15, 0.25, 0.35, 0.4])
        body = [x for w in own for x in (([word()] if rng.random() < 0.6 else []) if rng.random() < share else [w, *([word()] if rng.random() < 0.1 else [])])]
        texts.append(" ".join([*(word() for _ in range(rng.randint(0, 90))), *body, *(word() for _ in range(rng.randint(0, 90)))]))
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], SCHEMA)
    bench = spark.createDataFrame([(i, " ".join(own)) for i, own in items], BENCH)
    (group,) = decontamination.indexes(bench, decontamination.term_weights(docs))
    return group[0], texts


def test_recall_against_all_windows(paraphrases):
    index, texts = paraphrases
    assert index.basis.shape[1] == decontamination.RANK < len(index.tokens) // 2
    want = {(i, item) for i, text in enumerate(texts) for item in all_windows_by_hand(index, text)}
    got = {(i, item) for i, text in enumerate(texts) for _, item, *_ in decontamination.search([index], pa.array([text]))}
    assert got <= want and len(want) > 40 and len(got & want) >= 0.95 * len(want)


def test_the_latent_space_chooses_the_candidates(paraphrases, monkeypatch):
    """Candidates change with the cosine asked for, and none is left where the space is taken away."""
    index, texts = paraphrases
    seen = []
    near = decontamination._Windows.near

    def counted(self, passages):
        found = near(self, passages)
        seen.append(len(found[0]))
        return found

    monkeypatch.setattr(decontamination._Windows, "near", counted)
    counts = []
    for cosine in (-1.0, decontamination.COSINE, 0.7):
        monkeypatch.setattr(decontamination, "COSINE", cosine)
        seen.clear()
        list(decontamination.search([index], pa.array(texts)))
        counts.append(sum(seen))
    assert counts[0] > 20 * counts[1] and counts[1] > counts[2] > 0
    monkeypatch.undo()
    assert not list(decontamination.search([index._replace(latent=np.zeros_like(index.latent))], pa.array(texts)))


def test_short_items(spark):
    """Items of 1 to 7 tokens verbatim; of 8 to 64, all that the subsequence and answer rule accepts in a text of their length."""
    rng = random.Random(9)
    common = [f"c{i}" for i in range(30)]
    word = lambda: rng.choice(common) if rng.random() < 0.4 else f"r{rng.randrange(100_000)}"
    items = [(i, [f"k{i}", *(word() for _ in range(i % 7))]) for i in range(40)] + [(100 + i, [word() for _ in range(8 + i % 57)]) for i in range(160)]
    rows, want = [], set()
    for i, own in items:
        for kind, share in enumerate((1.0, 0.8, 0.62)):
            if len(own) < 8 and kind:
                body = own[:-1] + [f"q{i}"]  # not verbatim
            else:
                kept = set(rng.sample(range(len(own)), -(-int(len(own) * share * 1000) // 1000))) | set(range(len(own) - len(own) // 4 - 1, len(own)))
                body = [w if k in kept else f"x{rng.randrange(100_000)}" for k, w in enumerate(own)]
                if share == 1.0 or subsequence_by_hand(own, body) >= 0.6 * len(own):
                    want.add((10 * i + kind, i))
            rows.append((10 * i + kind, " ".join([*(f"r{rng.randrange(100_000)}" for _ in range(61)), *body, *(f"r{rng.randrange(100_000)}" for _ in range(75))]), "en", "a", 1))
    bench = spark.createDataFrame([(i, " ".join(own)) for i, own in items] + [(999, " - ")], BENCH)
    got = {(r.doc_id, r.item_id) for r in decontamination.matches(spark.createDataFrame(rows, SCHEMA).repartition(4), bench).collect()}
    assert len(want) > 450 and got == want


@pytest.mark.parametrize("name", ["odd", "clashing", "empty"])
def test_decontamination_of_odd_tables(request, planted, spark, name):
    df = request.getfixturevalue(name)
    assert decontamination.matches(df, planted[1]).count() == 0
    for bench in (planted[1], spark.createDataFrame([], BENCH)):
        out = decontamination.drop_contaminated(df, bench)
        assert out.schema == df.schema and out.count() == df.count()


def test_real_benchmark(spark, docs):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    want = set()
    items = {r.item_id: " ".join(words(r.text)) for r in bench.collect()}
    for r in docs.collect():
        text = f" {' '.join(words(r.text))} "
        want |= {(r.doc_id, i) for i, t in items.items() if t and f" {t} " in text}
    got = {(r.doc_id, r.item_id) for r in decontamination.matches(docs, bench).collect()}
    assert want and got == want


# Licenses.


def base_by_hand(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
    places = []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        places += [(k, label) for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
    at = [k for k, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


TEXTS = ["MIT License", "the mit-license, MIT\n\nLicense", "submit license", "Apache License apache license general public license", "émit license", "GENERAL  PUBLIC\tLICENSE 2", "mit license", "mit. license é"]


@pytest.mark.parametrize("name", ["odd", "clashing", "empty", "docs", "made"])
def test_base_phrases(request, spark, name):
    df = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(TEXTS)], SCHEMA) if name == "made" else request.getfixturevalue(name)
    want = Counter((r.doc_id, *base_by_hand(r.text)) for r in df.collect())
    got = licenses.scan(df).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) for r in got)


def test_words_end_at_ascii_marks_only(spark):
    texts = ["MIT License\u00a0: x", "x mit license\u3000x", "\u00a0MIT License", "apache license\u2009. MIT License", "MIT License : \u00a0", "GPL 2\u00a0: x", "gpl 2 only\u3000"]
    df = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], SCHEMA)
    got = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(df).collect()}
    assert got == {(i, *base_by_hand(t)) for i, t in enumerate(texts)}
    assert licenses.detect("gpl\u00a0") == licenses.detect("zlib license\u3000x") == []
    # every rule is bounded on both sides, whichever of its alternatives matches
    assert all(r.pattern.pattern.startswith("(?<![^ ])(?:") and r.pattern.pattern.endswith(")(?![^ ])") for r in licenses.RULES)


@pytest.mark.parametrize(("text", "labels"), [
    ("licensed under the apache license version 2 0", ["apache-2.0"]),
    ("gnu lesser general public license version 2 1", ["lgpl-2.1"]),
    ("gnu general public license version 3 or any later version", ["gpl-3.0-or-later"]),
    ("spdx license identifier bsd 3 clause", ["bsd-3-clause"]),
    ("cc by nc sa 4 0", ["cc-by-nc-sa-4.0"]),
    ("creative commons attribution sharealike 3 0", ["cc-by-sa-3.0"]),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", ["mit"]),
    ("mozilla public license v2 0 and the zlib license", ["mpl-2.0", "zlib"]),
    ("no license here", []),
])
def test_rules(text, labels):
    assert [d.label for d in licenses.detect(text)] == labels


def test_rules_are_many_and_gated():
    assert len(licenses.RULES) > 300 and len({(r.label, r.pattern.pattern) for r in licenses.RULES}) > 300
    assert all(any(g.decode() in r.keyword for g in licenses._GATES) for r in licenses.RULES)


def suppressed_by_hand(found):
    kept = []
    for d in sorted(found, key=lambda d: (-d.priority, d.start - d.end, d.start, d.label)):
        if not any(k.start <= d.start and d.end <= k.end for k in kept):
            kept.append(d)
    return sorted(kept)


DETECTIONS = st.lists(st.builds(lambda start, size, priority, label: licenses.Detection(start, start + size, priority, label), st.integers(0, 30), st.integers(1, 8), st.integers(1, 4), st.sampled_from("abc")), max_size=40)


@settings(deadline=None, max_examples=300)
@given(DETECTIONS)
def test_suppression_equals_comparing_all_pairs(found):
    assert licenses.suppress(found) == suppressed_by_hand(found)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.sampled_from("mit license apache general public gnu lesser version 2 3 0 bsd clause été 漢 \U0001f600 x or later under the terms of".split()), max_size=120))
def test_word_numbers(words):
    text = " ".join(words)
    rules = [(text.count(" ", 0, m.start()), m.group().count(" "), r) for r in licenses.RULES if r.keyword in text for m in r.pattern.finditer(text)]
    assert licenses.detect(text) == suppressed_by_hand([licenses.Detection(at, at + n + 1, r.priority, r.label) for at, n, r in rules])
    assert licenses.base_places(text) == sorted((text.count(" ", 0, m.start()), label) for pattern, label in licenses._BASE for m in pattern.finditer(text))


def test_many_licenses_in_one_text():
    text = " ".join(f"mit license text number {i}" for i in range(100_000))
    began = time.perf_counter()
    found, base = licenses.detect(text), licenses.base_places(text)
    assert len(base) == 100_000 and base[-1] == (499_995, "mit") and len(found) >= 100_000
    assert time.perf_counter() - began < 10


# Mixing.


def targets_by_hand(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Sources with a name first, in order of code points; excess is shared again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        unit = (total - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] >= most * sizes[s]}
        if not full:
            target |= {s: unit * weight[s] for s in open_}
            break
        target |= {s: most * sizes[s] for s in full}
        open_ -= full
    return target


def count_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("name", ["odd", "clashing", "empty", "docs"])
def test_mix(request, name):
    df = request.getfixturevalue(name)
    want = Counter((r.doc_id, count_words(r.text), r.source) for r in df.collect())
    got = mixing.mix(df).collect()
    assert Counter((r.doc_id, r.size, r.source) for r in got) == want
    sizes, largest, taken = Counter(), Counter(), Counter()
    for (_, size, source), n in want.items():
        sizes[source] += size * n
        largest[source] = max(largest[source], size)
    targets = targets_by_hand(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert r.taken == r.copies * r.size <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - targets[s]) <= largest[s] + 1e-6 for s in sizes)
    again = mixing.mix(df.repartition(5)).collect()
    assert Counter((r.doc_id, r.taken) for r in again) == Counter((r.doc_id, r.taken) for r in got)


def test_mix_keeps_expectations_and_uses_several_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 8)
    rows = [(i, "w " * (1 + i % 7), None, "hot" if i % 3 else "cold", 1) for i in range(600)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    for own in by.values():
        assert abs(sum(r.taken for r in own) - own[0].target) <= 7
        rate = own[0].target / own[0].source_size
        for size in range(1, 8):
            share = np.mean([r.copies for r in own if r.size == size])
            assert abs(share - rate) < 0.35


def test_mixed_documents_with_repeated_ids(spark):
    """Each id twice: of equal and of unequal texts, sizes and sources."""
    text = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    rows = [(i // 2, text(i // 4, 5 + i % 9 // 3 + i // 2 % 3), "en", "abc"[i // 40 % 3] if i % 10 else None, i) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("copies", F.lit("own"))
    taken, mixed = Counter(), Counter()
    for r in mixing.mix(df).collect():
        taken[r.doc_id, r.source, r.size] += r.copies
    out = mixing.take_mix(df).collect()
    assert out[0].__fields__ == [*df.columns, "copies_", "target"]
    assert len({r.n_chars for r in out}) == len(out) and {r.n_chars: r.text for r in out}.items() <= {r[4]: r[1] for r in rows}.items()
    for r in out:
        assert r.copies_ in (1, 2) and r.copies == "own"
        mixed[r.doc_id, r.source, count_words(r.text)] += r.copies_
    assert mixed == +taken


# The pipeline.


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    bench = [" ".join(re.findall(r"\w+", r.text.lower())) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        before, docs = {r.doc_id: r for r in docs.collect()}, spark.read.parquet(str(tmp_path / name))
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before) and docs.count() == len(after)
        if name != "mixing":
            assert docs.columns == columns
        kept[name] = len(after)
        if name == "quality":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
            assert np.mean([(i in after) == bool(q) for i, q in labels.items()]) > 0.95
        elif name == "exact_dedup":
            best = {}
            for i, r in before.items():
                best[r.text.translate(FOLD)] = max(i, best.get(r.text.translate(FOLD), -1))
            assert set(after) == set(best.values())
        elif name == "near_dedup":
            from test_dedup import near_by_hand

            want = near_by_hand([(i, r.text) for i, r in before.items()], 5)
            assert set(after) == {i for i, (_, c) in want.items() if c == i}
        elif name == "decontamination":
            dirty = {i for i, r in before.items() if any(f" {b} " in f" {' '.join(re.findall(r'\w+', r.text.lower()))} " for b in bench)}
            assert set(after) == set(before) - dirty
        else:
            assert all(r.copies in (1, 2) for r in after.values())
            words = sum(r.copies * count_words(r.text) for r in after.values())
            assert words == pytest.approx(1.5 * sum(count_words(r.text) for r in before.values()), rel=0.1)
    assert corpus_pipeline.run(spark, sf).count() == kept["mixing"]


@pytest.mark.parametrize("name", ["odd", "clashing", "empty"])
def test_filtering_stages_keep_all_columns(request, spark, name):
    df = request.getfixturevalue(name)
    sf = "/root/testdata/sf0.001"
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, sf)
        assert out.schema == df.schema
        assert out.count() <= df.count()
    mixed = corpus_pipeline.mix_sources(spark, df, sf)
    assert mixed.columns[: len(df.columns)] == df.columns and len(mixed.columns) == len(df.columns) + 2
    words = sum(r[len(df.columns)] * count_words(r.text) for r in mixed.collect())
    assert words == sum(r.taken for r in mixing.mix(df).collect())
    assert near_dedup.drop_near_duplicates(df).count() <= df.count()


def test_pipeline_of_an_empty_table(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    spark.read.parquet(f"{sf}/documents.parquet").where("false").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns[-2:] == ["copies", "target"]


def test_queries_are_named_by_number():
    names = queries.queries()
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
    assert set(queries.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_duckdb(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '/root/testdata/sf0.001/{table}.parquet'")
    own = queries.queries()[name](spark, "/root/testdata/sf0.001")
    sql = con.execute(queries.oracle_sql()[name])
    assert [d[0] for d in sql.description] == own.columns
    assert sorted(sql.fetchall(), key=repr) == sorted(map(tuple, own.collect()), key=repr)


def test_source_order_puts_null_last(spark):
    rows = spark.createDataFrame([("b", 10), (None, 10), ("B", 10)], "source string, size bigint")
    got = {r.source: r.number for r in mixing.source_targets(rows).collect()}
    assert got == {"B": 1, "b": 2, None: 3}
    assert mixing.source_targets(rows.where(F.lit(False))).count() == 0
