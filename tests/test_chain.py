"""Anchors and kept points over chunks of a track, against one pass over it."""

import random
import time
from datetime import datetime, timedelta
from statistics import median

import pytest

from wayspark.operators import chain, points, stops
from wayspark.operators.points import haversine

SCHEMA = "participant_id long, event_id long, ts timestamp_ntz, lat double, lon double"


def track(n, seed, pid=1, stay=0.8):
    """Short and long stays, slow walks and wild jumps."""
    rng = random.Random(seed)
    at, lat, lon, rows = datetime(2024, 1, 1), 48.8, 2.3, []
    for k in range(n):
        at += timedelta(seconds=rng.choice([5, 30, 60, 0]))
        if rng.random() > stay:
            lat, lon = lat + rng.gauss(0, 0.0006), lon + rng.gauss(0, 0.0006)
        if rng.random() < 0.005:
            lat, lon = 48.8 + rng.random() * 0.1, 2.3 + rng.random() * 0.1
        rows.append((pid, k, at, lat + rng.gauss(0, 0.0001), lon + rng.gauss(0, 0.0001)))
    return rows


def plain_stays(rows, least, radius):
    out, held = [], []
    for _, _, ts, lat, lon in rows:
        if held and haversine(*held[0][1:], lat, lon) > radius:
            if (ts - held[0][0]).total_seconds() > least:
                out.append((held[0][0], ts, median(p[1] for p in held), median(p[2] for p in held)))
            held = []
        held.append((ts, lat, lon))
    return out


def plain_kept(rows, kmh):
    last, out = None, []
    for _, k, ts, lat, lon in rows:
        if last is None or haversine(*last[1:], lat, lon) <= kmh / 3.6 * (ts - last[0]).total_seconds():
            last = (ts, lat, lon)
            out.append(k)
    return out


@pytest.mark.parametrize("stay,radius", [(0.8, 100.0), (0.999, 100.0), (0.0, 400.0)])
def test_one_participant_in_64_chunks(spark, stay, radius):
    rows = track(1280, 3, stay=stay)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = stops.stops_anchor(df, 300.0, radius, chunk=20).orderBy("start_time").collect()
    want = plain_stays(rows, 300.0, radius)
    assert [(r.start_time, r.end_time, r.lat, r.lon) for r in got] == want
    assert all(r.duration_s == (r.end_time - r.start_time).total_seconds() for r in got)
    marked = chain.follow(df, lambda ref, ts, lat, lon: haversine(*ref[2:], lat, lon) > radius, chunk=20)
    assert marked.select((marked["at"] / 20).cast("long")).distinct().count() >= 64


def test_kept_points(spark):
    rows = track(500, 5, 1) + track(300, 6, 2) + [(3, 0, datetime(2024, 1, 1), 1.0, 1.0)]
    got = points.drop_fast_since_kept(spark.createDataFrame(rows, SCHEMA).repartition(4), 20.0, chunk=16).collect()
    for pid in (1, 2, 3):
        assert sorted(r.event_id for r in got if r.participant_id == pid) == plain_kept([r for r in rows if r[0] == pid], 20.0)


def test_many_short_tracks_cost_their_points(spark):
    rows = [r for pid in range(3000) for r in track(5, pid, pid, 0.5)]
    began = time.monotonic()
    got = stops.stops_anchor(spark.createDataFrame(rows, SCHEMA), 20.0, 20.0).collect()
    took = time.monotonic() - began  # with a group of pandas for each track, minutes
    want = [(pid, *stay) for pid in range(3000) for stay in plain_stays(rows[5 * pid:5 * pid + 5], 20.0, 20.0)]
    assert sorted((r.participant_id, r.start_time, r.end_time, r.lat, r.lon) for r in got) == want and len(want) > 1000
    assert took < 30


def test_points_of_no_participant(spark):
    rows = [(pid, k, datetime(2024, 1, 1, 0, k), 48.8 + k // 4, 2.3) for pid in (None, 1) for k in range(6)]
    got = chain.follow(spark.createDataFrame(rows, SCHEMA), lambda ref, ts, lat, lon: haversine(*ref[2:], lat, lon) > 100.0, chunk=3).collect()
    assert sorted((r.participant_id is None, r.event_id) for r in got if r.is_ref) == [(False, 0), (False, 4), (True, 0), (True, 4)] and len(got) == 12


def test_no_points(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert stops.stops_anchor(none).count() == 0 and points.drop_fast_since_kept(none).count() == 0
