"""Every query with oracle SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from leafmill import catalog


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    show = lambda x: "null" if x is None or (isinstance(x, float) and math.isnan(x)) else f"{x:.6g}" if isinstance(x, float) else str(x)
    return [columns[k] for k in order], sorted(tuple(show(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, data, duck, name):
    df = catalog.QUERIES[name](spark, data)
    cursor = duck.execute(catalog.ORACLES[name])
    want = cursor.fetchall()
    assert canonical(df.columns, df.collect()) == canonical([c[0] for c in cursor.description], want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, data, name):
    assert catalog.QUERIES[name](spark, data).count() > 0


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
