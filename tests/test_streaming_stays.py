"""Stays over a stream whose rows come shuffled, against the batch detector."""

import random

import pytest
from pyspark.sql import functions as F

from wayspark.sources import fixtures
from wayspark.streaming.stays import stays


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def test_shuffled_stream_equals_batch(rocks, sf, tmp_path):
    points = fixtures.points(rocks, sf).select("participant_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "lat", "lon")
    rows = points.orderBy("ts").collect()
    rng = random.Random(1)
    # five files in the order of time, the rows of neighbours mixed, and one row too late for all
    files: list[list] = [[] for _ in range(5)]
    for k, r in enumerate(rows):
        files[min(4, max(0, k * 5 // len(rows) + rng.choice([0, 0, 1])))].append(r)
    too_late = (rows[0].participant_id, 10_000_000, rows[0].ts, 0.0, 0.0)
    closing = [(p, 20_000_000 + p, rows[-1].ts.replace(year=2030), 0.0, 0.0) for p in {r.participant_id for r in rows}]
    source = str(tmp_path / "in")
    rocks.createDataFrame([], points.schema).write.parquet(source)
    stream = rocks.readStream.schema(points.schema).parquet(source)
    query = stays(stream, 900.0, 400.0, "8 days").writeStream.format("memory").queryName("stays").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for k, f in enumerate([*files, [too_late], closing]):
            rng.shuffle(f)
            rocks.createDataFrame(f, points.schema).coalesce(1).write.mode("append").parquet(source)
            query.processAllAvailable()
    finally:
        query.stop()
    got = {(r.participant_id, r.start_time, r.end_time, r.lat, r.lon) for r in rocks.table("stays").collect()}
    whole = points.unionByName(rocks.createDataFrame(closing, points.schema))
    want = {(r.participant_id, r.start_time, r.end_time, r.lat, r.lon) for r in stays(whole, 900.0, 400.0).collect()}
    last = {(p, e) for p, _, e, *_ in want if e.year == 2030}  # ended by points that no later watermark passes
    assert {g for g in got if (g[0], g[2]) not in last} == {w for w in want if (w[0], w[2]) not in last}
    assert len(want) > 20 and len(want - got) <= len(last)
