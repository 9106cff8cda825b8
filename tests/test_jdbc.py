"""Partitioned reads from a database (the one that Spark brings along)."""

import uuid

import pytest
from pyspark.sql import functions as F

from wayspark.sources import fixtures, gps


@pytest.fixture
def database(spark, sf):
    options = {"url": f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    points = fixtures.points(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    odd = points.limit(5).withColumn("participant_id", F.lit(None).cast("long"))
    rows = points.unionByName(odd)
    rows.write.jdbc(options["url"], "points", properties={"driver": options["driver"]})
    return options, rows


def test_ranges_of_equal_rows(spark, database):
    options, rows = database
    got = gps.points_from_jdbc(spark, "points", column="event_id", parts=8, options=options)
    assert got.rdd.getNumPartitions() == 9
    sizes = sorted(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect())
    assert len(sizes) == 8 and sizes[-1] <= 1.2 * sizes[0]
    assert sorted(map(tuple, got.select("event_id", "ts", "lat").collect())) == sorted(map(tuple, rows.select("event_id", "ts", "lat").collect()))


def test_hot_values_and_pushed_filters(spark, database):
    options, rows = database
    got = gps.points_from_jdbc(spark, "points", column="participant_id", parts=4, options=options)
    assert got.count() == rows.count() and got.where("participant_id is null").count() == 5
    one = gps.points_of(got, 0).select("event_id")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "participant_id" in plan.split("PushedFilters")[1].split("]")[0] and "EqualTo" in plan
    assert "[event_id#" in plan and "lon#" not in plan
    assert {r[0] for r in one.collect()} == {r[0] for r in gps.points_of(rows, 0).select("event_id").collect()}


def test_ranges_of_times(spark, database):
    options, rows = database
    got = gps.points_from_jdbc(spark, "points", column="ts", parts=3, options=options)
    assert got.rdd.getNumPartitions() == 4 and got.count() == rows.count()
    assert got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 0.4 * rows.count()


def test_an_empty_table(spark, database):
    options, rows = database
    rows.limit(0).write.jdbc(options["url"], "nothing", properties={"driver": options["driver"]})
    assert gps.points_from_jdbc(spark, "nothing", column="event_id", parts=4, options=options).count() == 0
