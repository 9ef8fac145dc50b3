"""Every registered query against its DuckDB SQL on the sf0.001 tables."""

import math

import duckdb
import pytest

import __spark_entry__ as se
from riskframe.sources.tables import TABLES

from conftest import SF0001

SQL = se.oracle_sql()
QUERIES = se.queries()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    return c


_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF0001)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(SQL[name])
    cols, types = rel.columns, [str(t) for t in rel.types]
    assert sorted(cols) == sorted(df.columns)
    spark_types = dict(df.dtypes)
    assert [_TYPES.get(spark_types[c], spark_types[c]) for c in cols] == types
    assert got == _rows(cols, rel.fetchall())


def test_entry_runs(spark):
    df = se.entry(spark)
    assert df.count() >= 0
    assert "threshold" in df.columns
