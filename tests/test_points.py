import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from wayspark.functions import geo
from wayspark.operators import points

POINTS = "participant_id long, event_id long, ts timestamp_ntz, lat double, lon double"


def vincenty(lat1, lon1, lat2, lon2):
    """Inverse geodesic on WGS-84, iterated."""
    a, f = 6378137.0, 1 / 298.257223563
    b = (1 - f) * a
    u1, u2 = (math.atan((1 - f) * math.tan(math.radians(x))) for x in (lat1, lat2))
    d = lam = math.radians(lon2 - lon1)
    for _ in range(100):
        s = math.hypot(math.cos(u2) * math.sin(lam), math.cos(u1) * math.sin(u2) - math.sin(u1) * math.cos(u2) * math.cos(lam))
        if s == 0:
            return 0.0
        c = math.sin(u1) * math.sin(u2) + math.cos(u1) * math.cos(u2) * math.cos(lam)
        sigma = math.atan2(s, c)
        sa = math.cos(u1) * math.cos(u2) * math.sin(lam) / s
        ca = 1 - sa * sa
        m = c - 2 * math.sin(u1) * math.sin(u2) / ca if ca else 0.0
        k = f / 16 * ca * (4 + f * (4 - 3 * ca))
        new = d + (1 - k) * f * sa * (sigma + k * s * (m + k * c * (2 * m * m - 1)))
        if abs(new - lam) < 1e-13:
            break
        lam = new
    us = ca * (a * a - b * b) / (b * b)
    big = 1 + us / 16384 * (4096 + us * (us * (320 - 175 * us) - 768))
    small = us / 1024 * (256 + us * (us * (74 - 47 * us) - 128))
    ds = small * s * (m + small / 4 * (c * (2 * m * m - 1) - small / 6 * m * (4 * s * s - 3) * (4 * m * m - 3)))
    return b * big * (sigma - ds)


def test_geodesic_against_vincenty(spark):
    pairs = [(48.8, 2.3, 48.8001, 2.3001), (48.8, 2.3, 49.5, 3.9), (0.0, 10.0, 0.1, 10.1), (-33.9, 151.2, -34.0, 151.0), (48.8, 2.3, 48.8, 2.3)]
    df = spark.createDataFrame(pairs, "a double, b double, c double, d double")
    got = [r[0] for r in df.select(geo.geodesic_m(*map(F.col, "abcd"))).collect()]
    for g, p in zip(got, pairs):
        assert g == pytest.approx(vincenty(*p), rel=2e-6, abs=1e-6)


def test_steps_without_duration_or_distance(spark, at):
    rows = [(1, 1, at("8:00"), 48.0, 2.0), (1, 2, at("8:00"), 48.1, 2.0), (1, 3, at("8:01"), 48.1, 2.0), (2, 4, at("8:00"), 48.0, 2.0)]
    out = {r.event_id: r for r in points.with_steps(spark.createDataFrame(rows, POINTS)).collect()}
    assert out[1].dist_m is None and out[1].speed_kmh is None and out[4].dist_m is None
    assert out[2].time_diff_s == 0 and out[2].speed_kmh is None
    assert out[3].dist_m == 0 and out[3].speed_kmh == 0


def test_speed_filter_keeps_unknown_speed_and_does_not_recompute(spark, at):
    rows = [(1, 1, at("8:00"), 48.0, 2.0), (1, 2, at("8:01"), 48.5, 2.0), (1, 3, at("8:02"), 48.0, 2.0), (1, 4, at("8:03"), 48.0, 2.0)]
    kept = points.drop_fast(points.with_steps(spark.createDataFrame(rows, POINTS)))
    assert sorted(r.event_id for r in kept.collect()) == [1, 4]  # the point after the spike goes too
    kept = points.drop_fast_since_kept(spark.createDataFrame(rows, POINTS))
    assert sorted(r.event_id for r in kept.collect()) == [1, 3, 4]


def test_even_window_reaches_back(spark, at):
    rows = [(1, i, at(f"8:{i:02d}"), 48.0, 2.0) for i in range(12)]
    df = spark.createDataFrame(rows, POINTS).withColumn("speed_kmh", F.col("event_id").cast("double"))
    got = {r.event_id: r.speed_kmh_smooth for r in points.with_smooth_speed(df, 10).collect()}
    assert got[6] == sum(range(1, 11)) / 10 and got[0] == sum(range(5)) / 5


def test_local_time_in_summer_and_winter(spark):
    df = spark.createDataFrame([(datetime(2024, 7, 1, 12),), (datetime(2024, 1, 1, 12),), (datetime(2024, 3, 31, 1),)], "ts timestamp_ntz")
    assert [r[0].hour for r in df.select(points.to_local(F.col("ts"))).collect()] == [14, 13, 3]


def test_cleaning_drops_nulls_and_repeats(spark, at):
    rows = [(1, 1, at("8:00"), 48.0, 2.0), (1, 2, at("8:00"), 48.0, 2.0), (1, 3, at("9:00"), None, 2.0)]
    assert [r.event_id for r in points.clean_light(spark.createDataFrame(rows, POINTS)).collect()] == [1]


def test_empty_frames_keep_their_schema(spark):
    empty = spark.createDataFrame([], POINTS)
    assert points.prepared(empty).count() == 0
    assert "speed_kmh_smooth" in points.prepared(empty).columns
