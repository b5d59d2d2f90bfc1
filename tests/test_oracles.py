"""Every query with SQL against DuckDB on the smallest tables; every other one must run."""

import datetime
import os

import duckdb
import pandas as pd
import pytest

from tidemark import catalog

from .conftest import SF


def cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (datetime.datetime, pd.Timestamp)):
        return pd.Timestamp(v).tz_localize(None).isoformat()
    if type(v).__name__ == "Decimal":
        return str(int(v)) if v == int(v) else f"{float(v):.9g}"
    if isinstance(v, list):
        return str([cell(x) for x in v])
    return str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(cell(r[i]) for i in order) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name in catalog.SQL:
        q = duck.execute(catalog.SQL[name])
        assert table(df.columns, rows) == table([c[0] for c in q.description], q.fetchall())


def test_sql_has_queries():
    assert set(catalog.SQL) <= set(catalog.QUERIES)
