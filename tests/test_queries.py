"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as registry

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()
CORE = [name for name in ORACLE if not name.startswith("op")]


@pytest.fixture(scope="module")
def tables(small):
    con = duckdb.connect()
    for file in os.listdir(small):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{small}/{file}'")
    return con


def normal(rows, columns):
    def text(v):
        return "NULL" if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v)

    return sorted(tuple(text(row[c]) for c in columns) for row in rows)


@pytest.mark.parametrize("name", CORE)
def test_query_matches_sql(spark, small, tables, name):
    got = QUERIES[name](spark, small)
    want = tables.sql(ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    wanted = [dict(zip(want.columns, row)) for row in want.fetchall()]
    assert normal((row.asDict() for row in got.collect()), columns) == normal(wanted, columns)


def test_every_query_of_the_core_has_sql():
    assert {n for n in QUERIES if not n.startswith("op") and n != "pipeline"} == set(CORE)


def test_entry(spark):
    assert registry.entry(spark).count() == 1473
