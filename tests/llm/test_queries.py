"""The query functions that SQL cannot express whole: their columns, folds, and what SQL can say of them."""

from __future__ import annotations

import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from albumflow.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    ids = [r[0] for r in con.execute("SELECT doc_id FROM documents").fetchall()]
    rows = [(i, zlib.crc32(str(i).encode())) for i in ids]
    con.execute("CREATE TABLE folds (doc_id BIGINT, crc BIGINT)")
    con.executemany("INSERT INTO folds VALUES (?, ?)", rows)
    return con


def collected(spark, name, columns):
    out = queries.queries()[name](spark, SF)
    assert out.dtypes == columns
    return out.collect()


WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def test_language_query(spark, duck):
    rows = collected(spark, "op2_language", [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")])
    truth = duck.execute("SELECT doc_id, crc % 4 = 2, lang, regexp_matches(coalesce(text, ''), '\\p{L}') FROM documents JOIN folds USING (doc_id)").fetchall()
    want = {i: (held, lang, letters) for i, held, lang, letters in truth}
    assert len(rows) == len(want) and {r.doc_id: r.held_out for r in rows} == {i: w[0] for i, w in want.items()}
    known = {w[1] for w in want.values() if not w[0] and w[1] is not None}
    assert all((r.lang_pred == "und") != want[r.doc_id][2] and r.lang_pred in known | {"und"} and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == want[r.doc_id][1] for r in rows if r.held_out and want[r.doc_id][1] and want[r.doc_id][2]]) > 0.95


def test_quality_query(spark, duck):
    rows = collected(spark, "op6_quality", [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")])
    held = dict(duck.execute("SELECT doc_id, crc % 5 = 0 FROM folds").fetchall())
    assert {r.doc_id: r.held_out for r in rows} == held and len(rows) == len(held)
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    good = dict(duck.execute("SELECT doc_id, quality FROM labels").fetchall())
    assert np.mean([r.predicted == good[r.doc_id] for r in rows if r.doc_id in good and r.held_out]) > 0.8


def test_decontamination_query(spark, duck):
    rows = collected(spark, "op5_decontamination", [("doc_id", "bigint"), ("item_id", "bigint"), ("cosine", "double"), ("common", "double"), ("answer", "double")])
    text = r"' ' || array_to_string(regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), ' ') || ' '"
    whole = duck.execute(f"SELECT d.doc_id, b.item_id FROM (SELECT doc_id, {text} AS t FROM documents) d JOIN (SELECT item_id, {text} AS t FROM benchmark) b ON contains(d.t, b.t)").fetchall()
    assert whole and {(r.doc_id, r.item_id) for r in rows} == set(whole)


def test_license_query_base_columns(spark, duck):
    kinds = [("doc_id", "bigint"), ("n_words", "bigint"), ("n_base", "bigint"), ("first_word", "bigint"), ("last_word", "bigint"), ("base_labels", "string"), ("labels", "string"), ("score", "double")]
    rows = collected(spark, "op8_licenses", kinds)
    sql = rf"""
        WITH split AS (SELECT doc_id, regexp_extract_all({FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM split),
        hits AS (SELECT doc_id, i - 1 AS i, CASE WHEN array_to_string(w[i:i + 1], ' ') = 'mit license' THEN 'mit' WHEN array_to_string(w[i:i + 1], ' ') = 'apache license' THEN 'apache'
          WHEN array_to_string(w[i:i + 2], ' ') = 'general public license' THEN 'gpl' END AS label FROM places)
        SELECT doc_id, len(w), count(label), min(i) FILTER (label IS NOT NULL), max(i) FILTER (label IS NOT NULL), coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (label IS NOT NULL)), ','), '')
        FROM split LEFT JOIN hits USING (doc_id) GROUP BY doc_id, len(w)"""
    want = duck.execute(sql).fetchall()
    assert sorted(tuple(r)[:6] for r in rows) == sorted(want) and any(w[2] for w in want)
    assert all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) for r in rows if r.base_labels)


def test_mixing_query_targets(spark, duck):
    kinds = [("doc_id", "bigint"), ("size", "bigint"), ("source_size", "bigint"), ("target", "double"), ("taken", "bigint")]
    rows = collected(spark, "op9_mixing", kinds)
    sizes = duck.execute(f"SELECT doc_id, len({WORDS.format("coalesce(text, '')")}) AS size, source FROM documents").fetchall()
    total = {}
    for _, size, source in sizes:
        total[source] = total.get(source, 0) + size
    from test_texts import targets_by_hand

    target = targets_by_hand(total)
    assert sorted((r.doc_id, r.size, r.source_size, round(r.target, 6)) for r in rows) == sorted((i, n, total[s], round(target[s], 6)) for i, n, s in sizes)
    taken, largest, source_of = {}, {}, {i: s for i, _, s in sizes}
    for r in rows:
        s = source_of[r.doc_id]
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s], largest[s] = taken.get(s, 0) + r.taken, max(largest.get(s, 0), r.size)
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in taken)


def test_scoring_query_counts(spark, duck):
    kinds = [("doc_id", "bigint"), ("held_out", "boolean"), ("n_tokens", "bigint"), ("n_known", "bigint"), ("train_tokens", "bigint"), ("base_score", "double"), ("score", "double")]
    rows = collected(spark, "op10_lm_scoring", kinds)
    sql = f"""
        WITH tokens AS (SELECT doc_id, crc % 5 = 1 AS held, unnest(list_append({WORDS.format(FOLDED)}, ' ')) AS w FROM documents JOIN folds USING (doc_id)),
        counts AS (SELECT w, count(*) AS c FROM tokens WHERE NOT held GROUP BY w),
        totals AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM counts)
        SELECT doc_id, held, count(*), count(c), max(n), sum(log10((coalesce(c, 0) + 0.5) / (n + 0.5 * (v + 1))))
        FROM tokens LEFT JOIN counts USING (w), totals GROUP BY doc_id, held"""
    want = {r[0]: r[1:] for r in duck.execute(sql).fetchall()}
    assert len(rows) == len(want)
    for r in rows:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert r.base_score == pytest.approx(want[r.doc_id][4], rel=1e-6) and r.score < 0


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_of_an_empty_table(spark, tmp_path, name):
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{table}.parquet").write.parquet(str(tmp_path / f"{table}.parquet"))
    for table in ("documents", "pages"):
        spark.read.parquet(f"{SF}/{table}.parquet").where(F.lit(False)).write.parquet(str(tmp_path / f"{table}.parquet"))
    assert queries.queries()[name](spark, str(tmp_path)).count() == 0
