"""Searches in quadtrees against all pairs, and how many rows they meet."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from wayspark.functions.geo import geodesic_m, planar_m
from wayspark.operators import moves, privacy, quadtree
from wayspark.plans.oracle import lambert

PLANAR = lambda y1, x1, y2, x2: planar_m(x1, y1, x2, y2)


def spot(n, seed, wide=10_000.0):
    """n sites of which nine tenths lie in a thousandth of the width, some at one place."""
    rng = random.Random(seed)
    at = lambda k: (rng.random() * wide, rng.random() * wide) if k % 10 == 0 else (3000 + rng.random() * wide / 1000, 4000 + rng.random() * wide / 1000)
    sites = [(k, *at(k)) for k in range(n)]
    return sites + [(n + k, *sites[1][1:]) for k in range(20)]


def frame(spark, rows, names="id long, x double, y double"):
    return spark.createDataFrame(rows, names).repartition(3)


def test_nearest_sites(spark):
    sites = spot(400, 1)
    rng = random.Random(2)
    points = [(k, 2995 + rng.random() * 25, 3995 + rng.random() * 25) if k % 2 else (k, rng.random() * 30_000 - 10_000, rng.random() * 9000) for k in range(120)]
    tree = quadtree.build(frame(spark, sites, "site long, sx double, sy double"), "sx", "sy", ["site"])
    at = frame(spark, points)
    for k in (1, 3):
        got = quadtree.knn(at, tree, ["id"], ("y", "x"), ("sy", "sx"), ["site"], PLANAR, k).collect()
        assert len(got) == k * len(points)
        found = {(r.id, r["rank"]): r.site for r in got}
        for i, x, y in points:
            best = sorted((math.hypot(x - a, y - b), s) for s, a, b in sites)[:k]
            assert [found[i, r + 1] for r in range(k)] == [s for _, s in best]
    near = quadtree.knn(at, tree, ["id"], ("y", "x"), ("sy", "sx"), ["site"], PLANAR, 1, most=4.0).collect()
    assert {r.id for r in near} == {i for i, x, y in points if min(math.hypot(x - a, y - b) for _, a, b in sites) <= 4.0}


def test_rows_are_in_proportion_to_the_sites(spark):
    for n in (500, 2000, 8000):
        sites = frame(spark, spot(n, 4))
        tree = quadtree.build(sites.select(F.col("x").alias("sx"), F.col("y").alias("sy"), "id"), "sx", "sy", ["id"])
        assert quadtree.candidates(sites, tree, ["id"], ("y", "x"), 5).count() < 60 * n


def test_trees_by_key_on_a_sphere(spark):
    rng = random.Random(6)
    stops = [(p, k, "Home", 48.8 + p + rng.random() * 0.004, 2.3 + rng.random() * 0.004) for p in range(3) for k in range(60)] + [(1, 99, "Work", None, 2.0)]
    ends = [(p, k, "origin", 48.8 + p + rng.random() * 0.006, 2.3 + rng.random() * 0.006) for p in range(4) for k in range(15)] + [(0, 99, "origin", None, None)]
    got = moves.nearest_places(
        frame(spark, ends, "participant_id long, move_id long, side string, lat double, lon double"),
        frame(spark, stops, "participant_id long, stop_seq long, place_type string, lat double, lon double"), 200.0, 3,
    ).select("participant_id", "move_id", "rank", "stop_seq").collect()
    pairs = frame(spark, [(e[0], e[1], s[1], *e[3:], *s[3:]) for e in ends for s in stops if e[0] == s[0] and e[3] and s[3]], "p long, m long, s long, a double, b double, c double, d double")
    want = {}
    for r in pairs.withColumn("dist", geodesic_m(*map(F.col, "abcd"))).where("dist <= 200").collect():
        want.setdefault((r.p, r.m), []).append((r.dist, r.s))
    want = {(p, m, k + 1, s) for (p, m), rows in want.items() for k, (_, s) in enumerate(sorted(rows)[:3])}
    assert set(map(tuple, got)) == want and len(got) == len(want)


@pytest.mark.parametrize("alpha", [60.0, 5.0, 150.0, 200.0])
def test_wedge_counts(spark, alpha):
    rng = random.Random(8)
    sites = [(k, 1 + k % 2, x, y) for k, x, y in spot(300, 9)]
    apexes = [(k, 1 + k % 2, rng.random() * 10_000, rng.random() * 10_000, rng.random() * 360) for k in range(60)]
    apexes += [(100 + k, 1, sites[2 * k][2], sites[2 * k][3], 45.0 * k) for k in range(8)] + [(200, 1, 1.0, 1.0, None), (201, 3, 1.0, 1.0, 5.0)]
    apexes += [(300 + k, 1 + k % 2, 3000 + rng.random() * 10, 4000 + rng.random() * 10, rng.random() * 360) for k in range(40)]
    got = privacy.sites_in_wedges(frame(spark, apexes, "id long, cell long, x double, y double, _direction double"), frame(spark, sites, "site_id long, cluster_id long, x double, y double"), ["id"], alpha)
    found = {r.id: r.n_in for r in got.collect()}
    for i, cell, x, y, d in apexes:
        n = 0
        for _, c, sx, sy in sites:
            if d is not None and c == cell:
                apart = abs(math.degrees(math.atan2(sy - y, sx - x)) % 360 - d)
                n += apart <= alpha / 2 or 360 - apart <= alpha / 2
        assert found.get(i, 0) == n, (i, found.get(i), n)


def test_few_sites(spark):
    names = "site long, sx double, sy double"
    assert quadtree.build(frame(spark, [], names), "sx", "sy", ["site"]) is None
    assert quadtree.build(frame(spark, [(1, None, 2.0)], names), "sx", "sy", ["site"]) is None
    one = quadtree.build(frame(spark, [(k, 5.0, 5.0) for k in range(40)], names), "sx", "sy", ["site"])
    got = quadtree.knn(frame(spark, [(1, 0.0, 5.0), (2, None, 1.0)]), one, ["id"], ("y", "x"), ("sy", "sx"), ["site"], PLANAR, 2).collect()
    assert [(r.id, r.site, r.dist_m) for r in sorted(got)] == [(1, 0, 5.0), (1, 1, 5.0)]
    assert one.depth == 0


def test_wedges_meet_few_rows_of_large_clusters(spark, monkeypatch):
    """A row for each wedge and leaf that its sides cut, not one for each of some sites; counts as by all sites."""
    made = {}

    def durable(df, name, real=privacy.durable):
        made[name] = real(df, name)
        return made[name]

    monkeypatch.setattr(privacy, "durable", durable)
    rng = random.Random(11)
    sites = [(k, 1, rng.random() * 10_000, rng.random() * 10_000) for k in range(3000)]
    apexes = [(k, 1, rng.random() * 10_000, rng.random() * 10_000, rng.random() * 360) for k in range(200)]
    names = "id long, cell long, x double, y double, _direction double"
    at, of = frame(spark, apexes, names), frame(spark, sites, "site_id long, cluster_id long, x double, y double")
    found = {r.id: r.n_in for r in privacy.sites_in_wedges(at, of, ["id"], 60.0).collect()}
    assert made["wedges"].count() <= 200
    assert found == {r.id: r.n_in for r in privacy.sites_in_wedges(at, of, ["id"], 60.0, leaf=256).collect()}
    assert made["wedges"].count() <= 20 * 200
    for i, _, x, y, d in apexes:
        apart = [abs(math.degrees(math.atan2(sy - y, sx - x)) % 360 - d) for _, _, sx, sy in sites]
        assert found.get(i, 0) == sum(a <= 30 or 360 - a <= 30 for a in apart)


def test_nearest_looks_up_a_place_once(spark, monkeypatch):
    asked = []

    def knn(points, *rest, real=quadtree.knn):
        asked.append(points.count())
        return real(points, *rest)

    monkeypatch.setattr(quadtree, "knn", knn)
    sites = frame(spark, [(k, k % 3, 10.0 * k, 5.0 * k) for k in range(50)], "site_id long, cluster_id long, x double, y double")
    points = [(k, 40.0 * (k % 7) + 1, 20.0 * (k % 7)) for k in range(300)] + [(300, None, 1.0)]
    got = {r.id: r.near_site for r in privacy.cell_of_point(frame(spark, points), sites, "id").collect()}
    assert got == {k: None if k == 300 else 4 * (k % 7) for k in range(301)} and asked == [7]


def test_places_as_near_as_rounding_come_in_the_order_of_sql(spark):
    """Stops that differ in the last bit of a coordinate, ranked as DuckDB ranks their distances."""
    rng = random.Random(13)
    stops, ends = [(276, 32, "Home", 48.822957200000005, 2.3289852), (276, 43, "Home", 48.8229572, 2.3289852)], [(276, 6, "origin", 48.822926, 2.328866), (276, 33, "origin", 48.822954, 2.329014)]
    for p in range(60):
        lat, lon = round(48.8 + rng.random() / 10, 7), round(2.3 + rng.random() / 10, 7)
        stops += [(p, k, "Home", lat + math.ulp(lat) * (k % 3 - 1), lon) for k in range(4)]
        ends += [(p, k, "origin", round(lat + rng.uniform(-1e-4, 1e-4), 7), round(lon + rng.uniform(-1e-4, 1e-4), 7)) for k in range(5)]
    got = moves.nearest_places(
        frame(spark, ends, "participant_id long, move_id long, side string, lat double, lon double"),
        frame(spark, stops, "participant_id long, stop_seq long, place_type string, lat double, lon double"), 200.0, 3,
    ).select("participant_id", "move_id", "rank", "stop_seq").collect()
    con = duckdb.connect()
    con.execute("create table pairs (p bigint, m bigint, s bigint, a double, b double, c double, d double)")
    con.executemany("insert into pairs values (?, ?, ?, ?, ?, ?, ?)", [(e[0], e[1], s[1], *e[3:], *s[3:]) for e in ends for s in stops if e[0] == s[0]])
    want = con.execute(f"select * from (select p, m, row_number() over (partition by p, m order by dist, s) as r, s from {lambert('pairs', 'a', 'b', 'c', 'd', 'dist')} where dist <= 200) where r <= 3").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 900
