"""Exact, near, substring and suffix dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import ODD, SCHEMA, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from albumflow.llm import bloom, components, exact_dedup, near_dedup, segments, substring_dedup, suffix_dedup

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


# Exact dedup.


def copies_by_hand(docs):
    groups = defaultdict(list)
    for i, t in docs:
        groups[(t or "").translate(FOLD)].append(i)
    out = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            out[i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("popular", [exact_dedup.POPULAR, 1])
@pytest.mark.parametrize("name", ["odd", "clashing", "empty", "docs"])
def test_copy_groups(request, name, popular, monkeypatch):
    monkeypatch.setattr(exact_dedup, "POPULAR", popular)
    df = request.getfixturevalue(name)
    assert Counter(map(tuple, exact_dedup.copy_groups(df).collect())) == copies_by_hand(rows(df))


@pytest.mark.parametrize("name", ["odd", "clashing", "empty"])
def test_drop_copies(request, name):
    df = request.getfixturevalue(name)
    out = exact_dedup.drop_copies(df)
    assert out.schema == df.schema
    want = {(keep, digest) for _, keep, _, _, digest in copies_by_hand(rows(df))}
    got = [(i, hashlib.sha256((t or "").translate(FOLD).encode()).hexdigest()) for i, t in rows(out)]
    assert len(got) == len(set(got)) and set(got) == want


def test_bloom_never_misses(spark):
    keys = spark.range(5000).select((F.col("id") % 3000).alias("key"))
    found = bloom.build(keys, 5000, at_least=2)
    assert found(np.arange(2000)).all() and found(np.arange(2000, 3000)).mean() < 0.2
    assert not bloom.build(keys.limit(0), 0)(np.arange(100)).any()


def test_bloom_of_many_pieces(spark, monkeypatch):
    """Pieces that are lists and bit maps, one key in a third of all rows, and fewer probes beyond the largest size."""
    monkeypatch.setattr(bloom, "PENDING", 3000)
    keys = spark.range(0, 60_000, numPartitions=7).select(F.when(F.col("id") % 3 == 0, -7).otherwise(F.col("id") % 35_000).alias("key"))
    times = Counter(r.key for r in keys.collect())
    for expected, few in ((60_000, bloom._FEW), (60_000, 100), (200_000, bloom._FEW)):
        monkeypatch.setattr(bloom, "_FEW", few)
        monkeypatch.setattr(bloom, "MAX_BITS", 1 << 19)
        again, every = bloom.build(keys, expected, at_least=2), bloom.build(keys, expected)
        assert again.probes == (4 if expected == 60_000 else 2)
        known = np.array(sorted(times))
        assert every(known).all() and again(np.array([k for k, n in times.items() if n > 1])).all()
        assert again(np.array([k for k, n in times.items() if n == 1])).mean() < 0.35 and every(np.arange(10**6, 10**6 + 5000)).mean() < 0.2


# Components.


def test_components_of_paths_stars_and_rings(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(700 + i, 700 + (i + 1) % 20) for i in range(20)]
    rng.shuffle(links)
    df = spark.createDataFrame([(max(x), min(x)) for x in links], "a bigint, b bigint").repartition(4)
    got = {r.node: r.component for r in components.components(df).collect()}
    assert set(got.values()) == {100, 500, 700} and len(got) == 61 + 60 + 20
    assert all(c == max(x for x in (100, 500, 700) if x <= n) for n, c in got.items())


# Near dedup.


def near_by_hand(docs, size, percent=80):
    sets, first = {}, {}
    for i, t in docs:
        w = WORD.findall((t or "").encode().lower())
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    ids = sorted(i for i in sets if i is not None and sets[i])
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            common = len(sets[a] & sets[b])
            if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i) if i in root else i) for i in sets}


def near_copies(n, seed=1):
    rng, base = random.Random(seed), prose(seed, 120).split()
    out = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randint(0, 8)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        out.append((1000 + i, " ".join(words), "en", "a", 1))
    return out


def check_near(df, size):
    want = near_by_hand(rows(df), size)
    for r in near_dedup.near_duplicates(df, size).collect():
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)
        else:
            assert r.component_id is None and r.kept


@pytest.mark.parametrize("name", ["odd", "clashing", "empty", "docs"])
@pytest.mark.parametrize("size", [4])
def test_near_duplicates(request, name, size):
    check_near(request.getfixturevalue(name), size)


@pytest.mark.parametrize("block", [near_dedup.BLOCK, 25])
def test_near_copies_in_whole_and_divided_clusters(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    other = [(i + 500, *rest) for i, *rest in near_copies(30, 2)]
    check_near(spark.createDataFrame(near_copies(90) + other, SCHEMA).repartition(4), 5)


def test_rows_left_over_in_a_divided_cluster_are_compared(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 25)
    monkeypatch.setattr(near_dedup, "_regions", lambda rows, clusters: spark.createDataFrame([], "block string, id bigint"))
    other = [(i + 500, *rest) for i, *rest in near_copies(30, 2)]
    check_near(spark.createDataFrame(near_copies(90) + other, SCHEMA).repartition(4), 5)


def test_drop_near_duplicates(spark, odd):
    df = odd.unionByName(spark.createDataFrame(near_copies(20), SCHEMA))
    out = near_dedup.drop_near_duplicates(df)
    want = near_by_hand(rows(df), 5)
    assert out.schema == df.schema
    assert sorted({i for i, _ in rows(out) if i is not None}) == sorted(i for i, (_, c) in want.items() if i is not None and c == i)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), min_size=1, max_size=10), min_size=1, max_size=9), st.booleans())
def test_confirmed_links_join_what_they_should(sets, invert):
    arrays = [np.array(sorted(s), dtype=np.uint64) for s in sets]
    old = near_dedup.POSTINGS
    near_dedup.POSTINGS = old if invert else 0
    try:
        a, b = near_dedup.confirmed(arrays, 80)
    finally:
        near_dedup.POSTINGS = old
    true = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    everyone = np.array(true, dtype=np.int64).reshape(-1, 2)
    assert (components.forest(len(sets), a, b) == components.forest(len(sets), everyone[:, 0], everyone[:, 1])).all()
    assert {(max(x), min(x)) for x in zip(a.tolist(), b.tolist(), strict=True)} <= set(true)
    root = np.arange(len(sets)) // 3
    a, b = near_dedup.confirmed(arrays, 80, root)
    assert (root[a] != root[b]).all()
    inside = np.flatnonzero(root[1:] == root[:-1])
    joined = [components.forest(len(sets), np.append(x, inside), np.append(y, inside + 1)) for x, y in ((a, b), everyone.T)]
    assert (joined[0] == joined[1]).all()


# Substring dedup.


def substrings_by_hand(docs):
    first, words = {}, {}
    for i, t in docs:
        words[i] = WORD.findall((t or "").encode())
        for k in range(len(words[i]) - 49):
            key = tuple(words[i][k : k + 50])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in words.items():
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = True
        out[i] = len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()
    return out


def passages(seed=5):
    """Documents that share passages of 49 to 120 words at any place."""
    rng = random.Random(seed)
    shared = [prose(100 + i, n).split() for i, n in enumerate((49, 50, 51, 75, 120))]
    out = []
    for i in range(40):
        words = prose(i, rng.randint(0, 60)).split()
        for _ in range(rng.randint(0, 3)):
            own = rng.choice(shared)
            cut = rng.randint(0, 5)
            words += own[cut:] + prose(1000 + rng.randrange(9999), rng.randint(0, 9)).split()
        out.append((i, " ".join(words), "en", "a", 1))
    return out


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_substring_dedup(spark, odd, batches, monkeypatch):
    monkeypatch.setattr(segments, "POPULAR", {1: 0, 2: 2}.get(batches, segments.POPULAR))
    monkeypatch.setattr(substring_dedup, "FANOUT", 2)
    df = odd.where("doc_id is null or doc_id > 5").withColumn("doc_id", F.col("doc_id") + 100).unionByName(spark.createDataFrame(passages(), SCHEMA)).repartition(3)
    want = substrings_by_hand([r for r in rows(df) if r[0] is not None])
    for r in substring_dedup.dedup(df, batches).collect():
        if r.doc_id is not None:
            assert (r.n_words, r.n_removed, r.kept_text) == want[r.doc_id], r.doc_id
        else:
            assert r.n_removed == 0


def test_index_is_compacted_and_remembers(spark):
    index = substring_dedup.FingerprintIndex(spark, fanout=2)
    text = prose(1, 80)
    batch = lambda i: spark.createDataFrame([(i, text)], "doc_id bigint, text string")
    assert index.add(batch(1)).collect() == []
    for i, history in ((2, batch(1)), (3, batch(1).unionByName(batch(2)))):
        (found,) = index.add(batch(i), history).collect()
        assert found.doc_id == i and min(s["from"] for s in found.spans) == 0 and max(s["to"] for s in found.spans) == 80
    assert len(index.runs) == 2 and sorted(t.name for t in spark.catalog.listTables() if t.name.startswith("fingerprints")) == sorted(n for r in index.runs for n in r)
    index.drop()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("fingerprints")]


def test_history_is_read_for_what_a_batch_meets_only(spark):
    """Of many earlier documents, verification reads the first of each segment that has a key in common with other content."""
    make = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    past = [(i, prose(i, 200)) for i in range(300)] + [(300 + i, prose(7, 200)) for i in range(20)]
    words = prose(7, 200).split()
    new = [(1000, prose(5000, 90)), (1001, " ".join(["other", *words[20:150], "end"])), (1002, prose(11, 200))]
    index = substring_dedup.FingerprintIndex(spark)
    index.add(make(past))
    found = {r.doc_id: r.spans for r in index.add(make(new), make(past)).collect()}
    assert 1 <= index.read_again.value <= 3  # document 7, and what the filter lets through wrongly
    want = substrings_by_hand(past + new)
    for doc_id, text in new:
        gone = segments.covered(found.get(doc_id), len(text.split()))
        assert int(gone.sum()) == want[doc_id][1]
    index.drop()


def test_tables_go_when_a_batch_fails(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "by_document", lambda spans: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        substring_dedup.dedup(spark.createDataFrame([(i, prose(i, 90)) for i in range(9)], "doc_id bigint, text string"))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("fingerprints")]


def test_history_is_not_shuffled(spark):
    """The merge joins of a new batch with a run of history need no exchange."""
    index = substring_dedup.FingerprintIndex(spark, fanout=9)
    for i in (1, 2):
        index.add(spark.createDataFrame([(i, prose(i, 300))], "doc_id bigint, text string"))
    past, new = ((spark.table(r.segments), spark.table(r.keys)) for r in index.runs)
    for old, own, by in ((past[0], new[0], substring_dedup.CLASS), (past[1], new[1], ["key"])):
        plan = old.hint("merge").join(own.select(*by), by, "left_semi")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    index.drop()


@pytest.mark.parametrize("name", ["clashing", "empty"])
def test_substring_dedup_of_odd_tables(request, name):
    df = request.getfixturevalue(name)
    assert substring_dedup.dedup(df).count() == df.count()


# Suffix-array dedup.


def bytes_by_hand(docs):
    count, data = Counter(), []
    for i, t in docs:
        b = (t or "").encode()
        data.append((i, b))
        if i is not None:
            count.update(b[k : k + 400] for k in range(len(b) - 399))
    out = Counter()
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 399):
            if i is not None and count[b[k : k + 400]] > 1:
                gone[k : k + 400] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i, len(b), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()] += 1
    return out


def byte_passages(seed=9):
    rng = random.Random(seed)
    shared = [prose(200 + i, 200)[:n] for i, n in enumerate((399, 400, 401, 450, 700))]
    out = []
    for i in range(30):
        parts = [prose(3000 + i, rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared)[rng.randint(0, 3) :], prose(4000 + rng.randrange(9999), rng.randint(0, 5))]
        out.append((i, "|".join(parts), "en", "a", 1))
    return out + [(50, "abcdefghij" * 90, "en", "a", 1), (51, "x" * 401, "en", "a", 1), (52, "y" * 400, "en", "a", 1)]


@pytest.mark.parametrize("large", [suffix_dedup.LARGE_KEY, 0])
def test_suffix_dedup(spark, odd, monkeypatch, large):
    monkeypatch.setattr(suffix_dedup, "LARGE_KEY", large)
    monkeypatch.setattr(suffix_dedup, "BLOCK_ROWS", 8)
    monkeypatch.setattr(segments, "POPULAR", 2 if large else segments.POPULAR)
    df = odd.where("doc_id is null or doc_id <> 8").unionByName(spark.createDataFrame(byte_passages(), SCHEMA).withColumn("doc_id", F.col("doc_id") + 100)).repartition(3)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(df).collect())
    assert got == bytes_by_hand(rows(df))


def test_suffix_dedup_of_very_long_texts(spark, monkeypatch):
    long = prose(77, 3000)
    rows_ = [(1, long + prose(78, 2000)), (2, prose(79, 700) + long), (3, long[:5000])]
    df = spark.createDataFrame(rows_, "doc_id bigint, text string")
    want = bytes_by_hand(rows_)
    kind = segments.Kind(False, suffix_dedup.LENGTH, suffix_dedup.GRAM)
    monkeypatch.setattr(segments, "LONG_PART", 1500)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": [rows_[0][1]]})
    seen = [place + a + i for _, _, s, place in segments.scan(kind, batch) for a, n in zip(s.start.tolist(), s.windows.tolist(), strict=True) for i in range(n)]
    assert sorted(seen) == list(range(len(rows_[0][1]) - suffix_dedup.LENGTH + 1))
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(df).collect())
    assert got == want


@pytest.mark.parametrize("name", ["clashing", "empty"])
def test_suffix_dedup_of_odd_tables(request, name):
    df = request.getfixturevalue(name)
    assert suffix_dedup.dedup(df).count() == df.count()


# Texts that a polynomial modulo a power of two cannot tell apart.


def alike(bits=10):
    """Two unequal words with one structure."""
    one = "".join("ab"[i.bit_count() % 2] for i in range(1 << bits))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_alike_words_are_no_near_copies(spark):
    a, b = alike()
    df = spark.createDataFrame([(1, f"x y z {a}"), (2, f"x y z {b}"), (3, f"{a} {b} c d e {b} {a} c d e")], "doc_id bigint, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df, 4).collect()}
    assert got == {(1, 1, 1, True), (2, 1, 2, True), (3, 7, 3, True)}


@pytest.mark.parametrize("batches", [1, 2])
def test_alike_words_are_no_repeated_passage(spark, batches):
    a, b = alike()
    words = prose(4, 49).split()
    rows_ = [(1, " ".join([*words, a])), (2, " ".join([*words, b])), (3, " ".join([*words[1:], a, b])), (4, " ".join(["q", *words[1:], a]))]
    df = spark.createDataFrame(rows_, "doc_id bigint, text string")
    want = substrings_by_hand(rows_)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.dedup(df, batches).collect()} == want and not want[2][1]


@pytest.mark.parametrize("large", [suffix_dedup.LARGE_KEY, 0])
def test_alike_bytes_are_no_repeated_string(spark, monkeypatch, large):
    monkeypatch.setattr(suffix_dedup, "LARGE_KEY", large)
    a, b = alike(8)
    key = prose(6, 40)[:144]
    rows_ = [(1, a + key), (2, b + key), (3, key + a), (4, key + b), (5, f"x{key}{b}y"), (6, alike()[0]), (7, alike()[1])]
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(spark.createDataFrame(rows_, "doc_id bigint, text string")).collect())
    assert got == bytes_by_hand(rows_)


def test_odd_rows_are_what_the_name_says():
    assert len(ODD) == 16
