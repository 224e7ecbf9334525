"""Every registered query of the engine gives the rows of its SQL."""

import datetime
import os

import duckdb
import pytest

from watchloom.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def views(con, folder):
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def rows_of(rows, columns, order):
    at = [columns.index(c) for c in order]
    value = lambda v: round(v, 6) if isinstance(v, float) else v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v
    return sorted((tuple(value(r[i]) for i in at) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    return views(duckdb.connect(), SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name not in SQL:
        assert got
        return
    rel = con.sql(SQL[name])
    order = sorted(rel.columns)
    assert sorted(df.columns) == order
    assert rows_of(got, df.columns, order) == rows_of(rel.fetchall(), rel.columns, order)


def test_entry_imports_without_the_optional_parts():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(SQL) <= set(e.oracle_sql())
