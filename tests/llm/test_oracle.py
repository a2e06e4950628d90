"""Queries with SQL beside them give the rows that DuckDB finds."""

import os

import duckdb
import pytest

from rankloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = duck.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    got = queries.queries()[name](spark, SF).select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(found.fetchall())
