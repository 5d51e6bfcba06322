"""Every query of the subpackage that has SQL against it, on the smallest tables."""

import os

import duckdb
import pytest

from puspark.llm import queries, sql
from tests.test_queries import normal


@pytest.fixture(scope="module")
def tables(small):
    con = duckdb.connect()
    for file in os.listdir(small):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{small}/{file}'")
    return con


@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_query_matches_sql(spark, small, tables, name):
    got = queries.QUERIES[name](spark, small)
    want = tables.sql(sql.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    wanted = [dict(zip(want.columns, row)) for row in want.fetchall()]
    assert normal((row.asDict() for row in got.collect()), columns) == normal(wanted, columns)
