"""Every query against its SQL in DuckDB."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from wayspark.plans.oracle import SQL
from wayspark.plans.queries import QUERIES


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or v != v:
            return ""
        v = v.item() if hasattr(v, "item") else v
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return repr(float(v))
        return str(v).replace(" 00:00:00", "")

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, sf, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_queries_without_sql_are_known():
    assert set(QUERIES) - set(SQL) == {"skmob_speed_filter", "stops_sliding", "greedy_k_clusters", "cluster_hulls", "cluster_stats", "pcells_buffer"}


def test_points_scan_has_every_event_and_participant(spark, sf):
    got = QUERIES["points_scan"](spark, sf)
    assert sorted(r[0] for r in got.select("event_id").collect()) == sorted(r[0] for r in spark.read.parquet(f"{sf}/events.parquet").select("event_id").collect())
    assert {r[0] for r in got.select("participant_id").distinct().collect()} == {r[0] for r in QUERIES["participants"](spark, sf).collect()}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
