"""Queries of the subpackage with SQL, against DuckDB."""

import glob
import os

import duckdb
import pytest

from tests_rows import rows
from wayspark.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    got, want = registry.queries()[name](spark, sf).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_operator_has_a_query():
    names = registry.queries()
    assert {int(n[2:].split("_")[0]) for n in names} == set(range(1, 14))
