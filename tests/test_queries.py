"""Registered queries against their SQL in DuckDB, over the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from webloom.plans import queries as engine

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


@pytest.mark.parametrize("name", sorted(engine.ORACLES))
def test_equals_sql(spark, sf, duck, name):
    df = engine.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    cursor = duck.execute(engine.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in cursor.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(engine.QUERIES) - set(engine.ORACLES)))
def test_has_rows(spark, sf, name):
    assert engine.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 25
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("column", ["url", "status_code", "title", "indexability"])
def test_grid_orders_are_whole(spark, sf, column):
    rows = engine.QUERIES[f"sort_{column}"](spark, sf).collect()
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert n > 100 and sorted(r.place for r in rows) == list(range(1, n + 1))
