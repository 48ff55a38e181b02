"""Every catalogue query against its SQL in DuckDB."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from albumflow.plans.catalogue import CATALOGUE
from albumflow.plans.oracles import oracle_sql

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()
ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return round(float(value), 6) if type(value).__name__ == "Decimal" else value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_has_sql():
    assert set(CATALOGUE) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(CATALOGUE))
def test_query(spark, duck, name):
    own = CATALOGUE[name](spark, SF)
    sql = duck.execute(ORACLES[name])
    names = [d[0] for d in sql.description]
    assert sorted(own.columns) == sorted(names)
    want, got = _rows(names, sql.fetchall()), _rows(own.columns, [tuple(r) for r in own.collect()])
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert all(a == b or (isinstance(a, float | int) and isinstance(b, float | int) and math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6)) for a, b in zip(g, w, strict=True)), (g, w)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
