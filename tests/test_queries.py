"""Every registered query with SQL gives the same rows in DuckDB; the others run."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from fidelis.plans.catalog import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    assert "CartesianProduct" not in df._jdf.queryExecution().executedPlan().toString()
    if name not in ORACLE:
        assert got
        return
    rel = duck.sql(ORACLE[name])
    assert sorted(rel.columns) == columns
    kinds = {c: str(t) for c, t in zip(rel.columns, rel.types, strict=True)}
    assert {c: TYPES[t] for c, t in df.dtypes} == kinds
    names = ", ".join(f'"{c}"' for c in columns)
    want = duck.sql(f"SELECT {names} FROM ({ORACLE[name]})").fetchall()
    assert ordered(got) == ordered(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
