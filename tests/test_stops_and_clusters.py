import math
import random
import time
from datetime import datetime, timedelta
from statistics import median

import pytest
from pyspark.sql import functions as F

from wayspark.operators import cluster, moves, places, points, privacy, stops

POINTS = "participant_id long, event_id long, ts timestamp_ntz, lat double, lon double"
STOPS = "participant_id long, stop_seq long, start_time timestamp_ntz, end_time timestamp_ntz, duration_s double, lat double, lon double"
METRE = 1 / 111_195.08  # degrees of latitude


def walk(*legs):
    """Points from (minutes, metres north) legs, one a minute, starting at 8:00."""
    out, t, y = [], datetime(2024, 1, 2, 8), 0.0
    for minutes, step in legs:
        for _ in range(minutes):
            out.append((1, len(out), t, 48 + y * METRE, 2.0))
            t, y = t + timedelta(minutes=1), y + step
    return out


@pytest.mark.parametrize("legs, n", [(((10, 1), (5, 500)), 1), (((3, 1), (5, 500)), 0), (((10, 1), (5, 500), (10, 1)), 2), ((), 0)])
def test_sliding_stops(spark, legs, n):
    found = stops.stops_sliding(spark.createDataFrame(walk(*legs), POINTS)).collect()
    assert len(found) == n
    assert all(r.duration_s >= 300 for r in found)


def test_anchor_stop_ends_with_the_point_outside(spark):
    rows = walk((10, 1), (3, 500))
    got = stops.stops_anchor(spark.createDataFrame(rows, POINTS)).collect()
    assert [(r.start_time, r.end_time) for r in got] == [(rows[0][2], rows[11][2])]
    assert not stops.stops_anchor(spark.createDataFrame(rows[:9], POINTS)).collect()  # still open


def stop(seq, metres, start="8:00", end="9:00", pid=1):
    a, b = (datetime(2024, 1, 2, *map(int, x.split(":"))) for x in (start, end))
    return pid, seq, a, b, (b - a).total_seconds(), 48 + metres * METRE, 2.0


def test_dbscan_chains_and_participants(spark):
    rows = [stop(1, 0), stop(2, 100), stop(3, 200), stop(4, 1000), stop(1, 0, pid=2)]
    got = {(r.participant_id, r.stop_seq): r.cluster for r in cluster.dbscan(spark.createDataFrame(rows, STOPS)).collect()}
    assert got == {(1, 1): 0, (1, 2): 0, (1, 3): 0, (1, 4): 1, (2, 1): 0}


def test_dbscan_border_and_noise(spark):
    rows = [stop(1, 0), stop(2, 10), stop(3, 20), stop(4, 115), stop(5, 500)]
    got = {r.stop_seq: r.cluster for r in cluster.dbscan(spark.createDataFrame(rows, STOPS), 100.0, 4).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 0, 5: -1}  # 3 alone has four within 100 m; 1, 2 and 4 are its border


def test_grouping_bounds(spark):
    rows = [stop(1, 0, "8:00", "8:30"), stop(2, 150, "8:40", "9:00"), stop(3, 150, "8:50", "9:10"), stop(4, 150, "9:21", "9:30"), stop(5, 900, "9:31", "9:40")]
    sizes = sorted(r.group_size for r in cluster.group_stops(spark.createDataFrame(rows, STOPS)).collect())
    assert sizes == [1, 1, 3]  # exactly 600 s and an overlap join; 660 s and 750 m don't


def test_home_and_work_meet_through_another_place(spark):
    df = spark.createDataFrame([(*stop(1, 0), "Home"), (*stop(2, 100), "autre"), (*stop(3, 200), "Work")], STOPS + ", place_type string")
    assert [r.place_type for r in cluster.merge_close_stops(df).collect()] == ["Home"]
    assert cluster.merge_close_stops(df.where("stop_seq <> 2").withColumn("lat", F.lit(48.0))).count() == 2


@pytest.mark.parametrize("start, end, night", [("23:10", "3 5:00", False), ("22:30", "3 7:00", True), ("9:00", "10:00", False), ("7:59", "8:00", False), ("6:30", "7:00", True)])
def test_window_counts_hours_of_the_first_date(spark, at, start, end, night):
    df = spark.createDataFrame([(1, 1, at(start), at(end), 1.0, 48.0, 2.0)], STOPS)
    assert df.select(places.covers_window(places.HOME_HOURS)).first()[0] is night


@pytest.mark.parametrize("start, end, night", [("23:10", "3 5:00", True), ("9:00", "19:59", False), ("9:00", "3 0:30", True), ("8:01", "3 8:00", True)])
def test_window_over_midnight(spark, at, start, end, night):
    df = spark.createDataFrame([(1, 1, at(start), at(end), 1.0, 48.0, 2.0)], STOPS)
    assert df.select(places.covers_window(places.HOME_HOURS, cross_midnight=True)).first()[0] is night


def test_work_overrides_home_nearby(spark):
    rows = [stop(1, 0, "20:00", "23:00"), stop(2, 50, "9:00", "12:00"), stop(3, 5000, "13:00", "13:30")]
    got = {r.stop_seq: r.place_type for r in places.classify_home_work(spark.createDataFrame(rows, STOPS)).collect()}
    assert got[1] == "Home" and got[3] == "Work"


def test_moves_need_stops_and_two_points(spark, at):
    pts = spark.createDataFrame(walk((60, 10)), POINTS)
    none = spark.createDataFrame([], STOPS)
    assert moves.moves(pts, none).count() == 0
    one = spark.createDataFrame([stop(1, 0, "8:20", "8:30")], STOPS)
    got = moves.moves(pts, one).orderBy("start_time").collect()
    assert [(r.start_time, r.end_time) for r in got] == [(at("8:00"), at("8:20")), (at("8:30"), at("8:59"))]


def test_inside_and_outside_split_the_points(spark):
    pts = spark.createDataFrame(walk((60, 10)), POINTS)
    spans = spark.createDataFrame([stop(1, 0, "8:10", "8:20"), stop(2, 0, "8:15", "8:30")], STOPS)
    a, b = (moves.split_points(pts, spans, m) for m in (False, True))
    assert a.count() == 21 and b.count() == 39 and a.unionByName(b).distinct().count() == 60


def greedy(sites, k):
    """All edges by length, source and target, one after the other."""
    edges = sorted((((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) ** 0.5, a[0], b[0]) for a in sites for b in sites if a[0] < b[0])
    own = {s[0]: s[0] for s in sites}
    for _, a, b in edges:
        ca, cb = own[a], own[b]
        na, nb = (sum(v == c for v in own.values()) for c in (ca, cb))
        if ca != cb and min(na, nb) < k:
            old, new = (cb, ca) if na >= nb else (ca, cb)
            own = {s: new if c == old else c for s, c in own.items()}
    return own


@pytest.mark.parametrize("seed, n, k", [(1, 60, 4), (2, 45, 3), (3, 7, 4), (4, 3, 4), (0, 40, 4), (5, 90, 6)])
def test_greedy_clusters_like_one_edge_at_a_time(spark, seed, n, k):
    rng = random.Random(seed)
    # seed 0: a row of sites with ever shorter gaps
    sites = [(i, rng.uniform(0, 1000), rng.uniform(0, 1000)) for i in range(n)] if seed else [(i, 100 * i - i * i, 0.0) for i in range(n)]
    sites = [(i, float(x), float(y)) for i, x, y in sites]
    found, merges = privacy.greedy_clusters(spark.createDataFrame(sites, "site_id long, x double, y double"), k)
    got = {r.site_id: r.cluster_id for r in found.collect()}
    assert got == greedy(sites, k)
    assert merges.count() == n - len(set(got.values()))


def test_hulls_of_small_clusters(spark):
    rows = [(1, 0.0, 0.0, 1), (2, 2.0, 0.0, 1), (3, 0.0, 2.0, 1), (4, 0.5, 0.5, 1), (5, 9.0, 9.0, 2), (6, 0.0, 7.0, 3), (7, 3.0, 11.0, 3)]
    got = privacy.cluster_hulls(spark.createDataFrame(rows, "site_id long, x double, y double, cluster_id long")).toPandas()
    assert got.groupby("cluster_id").size().to_dict() == {1: 3, 2: 1, 3: 2}
    assert got[got.cluster_id == 3].perimeter.iloc[0] == 10


def test_truncation_keeps_a_middle_part_or_nothing(spark):
    sites = spark.createDataFrame([(1, 0.0, 0.0, 1), (2, 100.0, 0.0, 2)], "site_id long, x double, y double, cluster_id long")
    t = datetime(2024, 1, 2)
    rows = [("a", i, t + timedelta(minutes=i), i, float(10 * i), float(i % 2)) for i in range(1, 10)] + [("b", i, t, 100 + i, float(i), 0.0) for i in range(1, 4)]
    traj = spark.createDataFrame(rows, "traj_id string, pos long, ts timestamp_ntz, event_id long, x double, y double")
    celled = privacy.cell_of_point(traj, sites, "event_id")
    assert celled.where("traj_id = 'b'").select("cell").distinct().collect()[0].cell == 1
    kept = privacy.truncate(celled, sites).orderBy("pos").collect()
    assert all(r.traj_id == "a" for r in kept)
    assert [r.pos for r in kept] == list(range(kept[0].pos, kept[-1].pos + 1)) if kept else True


def test_step_speed_of_one_point(spark, at):
    one = spark.createDataFrame([(1, 1, at("8:00"), 48.0, 2.0)], POINTS)
    assert points.prepared(one).first().speed_kmh_smooth is None


def test_nearest_keeps_points_without_a_place_and_far_ones(spark):
    rng = random.Random(7)
    sites = [(i, rng.uniform(0, 100), rng.uniform(0, 100), i % 3) for i in range(30)] + [(90, None, 1.0, 1)]
    rows = [(i, rng.uniform(-10, 110), rng.uniform(-10, 110)) for i in range(60)] + [(60, None, 1.0), (61, 1.0, None), (62, 1e7, -1e7)]
    df = spark.createDataFrame(rows, "pid long, x double, y double")
    of = spark.createDataFrame(sites, "site_id long, x double, y double, cluster_id long")
    got = {r.pid: r for r in privacy.cell_of_point(df, of, "pid").collect()}
    assert len(got) == len(rows) and got[60].cell is None and got[61].near_site is None
    for i, x, y in rows:
        if x is not None and y is not None:
            d, site = min((((x - a) ** 2 + (y - b) ** 2) ** 0.5, s) for s, a, b, _ in sites if a is not None)
            assert got[i].near_site == site and got[i].dist == pytest.approx(d)
    assert {r.cell for r in privacy.cell_of_point(df, of.limit(0), "pid").collect()} == {None}
    assert privacy.cell_of_point(df, of.where("site_id = 3"), "pid").where("cell is not null").count() == 61
    assert privacy.cell_of_point(df.limit(0), of, "pid").count() == 0


def test_cluster_stats(spark):
    clusters = spark.createDataFrame([(i, 0.0, 0.0, i // 4) for i in range(10)], "site_id long, x double, y double, cluster_id long")
    merges = spark.createDataFrame([(1, 2, 1.5), (2, 3, 2.0)], "source long, target long, length double")
    assert privacy.cluster_stats(clusters, merges).first().asDict() == {"n_clusters": 3, "n_sites": 10, "mean_sites": 10 / 3, "merge_length": 3.5}
    assert privacy.cluster_stats(clusters.limit(0), merges.limit(0)).first().asDict() == {"n_clusters": 0, "n_sites": 0, "mean_sites": None, "merge_length": 0.0}


def metres(a, b):
    p, q = map(math.radians, (a[0], b[0]))
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371008.8 * math.asin(math.sqrt(h))


def plain_dbscan(at, eps, k):
    """Labels by looking at all pairs; clusters are numbered by their first core."""
    near = {i: [j for j in at if None not in at[i] + at[j] and metres(at[i], at[j]) <= eps] or [i] for i in at}
    cores = [i for i in sorted(at) if len(near[i]) >= k]
    label, n = {}, 0
    for i in cores:
        if i not in label:
            stack = [i]
            while stack:
                j = stack.pop()
                if j not in label:
                    label[j] = n
                    stack += [x for x in near[j] if x in cores]
            n += 1
    own = dict(label)
    return {i: own.get(i, min((own[j] for j in near[i] if j in own), default=-1)) for i in at}


@pytest.mark.parametrize("seed, lat, lon, k", [(1, 48.0, 2.0, 1), (2, -0.001, -0.001, 1), (3, 75.0, 179.0, 1), (4, 48.0, 2.0, 4), (5, -60.0, -5.0, 5), (6, 0.0, 0.0, 3)])
def test_dbscan_against_all_pairs(spark, seed, lat, lon, k):
    rng = random.Random(seed)
    at = {i: (lat + rng.uniform(-1200, 1200) * METRE, lon + rng.uniform(-1200, 1200) * METRE / math.cos(math.radians(lat))) for i in range(150)}
    at |= {200 + i: (at[i][0] + rng.gauss(0, 20) * METRE, at[i][1]) for i in range(0, 150, 2)} | {400 + i: at[i] for i in range(3)}
    at |= {500: (None, lon), 501: (lat, None), 502: (None, None)}
    day = datetime(2024, 1, 2)
    rows = [(1, i, day, day, 0.0, *p) for i, p in at.items()]
    got = {r.stop_seq: r.cluster for r in cluster.dbscan(spark.createDataFrame(rows, STOPS), 150.0, k).collect()}
    assert got == plain_dbscan(at, 150.0, k)


def test_dense_places_just_out_of_reach(spark):
    """Two crowds whose cells are neighbours: one pair near enough links them, none doesn't."""
    rng = random.Random(3)
    day = datetime(2024, 1, 2)
    crowd = lambda seq, y: [(1, seq + i, day, day, 0.0, 48 + (y + (rng.uniform(-20, 0) if seq == 0 else rng.uniform(0, 20))) * METRE, 2.0 + rng.uniform(-1e-4, 1e-4)) for i in range(120)]
    rows = crowd(0, 0) + crowd(1000, 151)
    df = spark.createDataFrame(rows, STOPS)
    assert cluster.dbscan(df, 150.0).select("cluster").distinct().count() == 2
    bridge = spark.createDataFrame([(1, 5000, day, day, 0.0, 48 + 0.5 * METRE, 2.0), (1, 5001, day, day, 0.0, 48 + 150.4 * METRE, 2.0)], STOPS)
    assert cluster.dbscan(df.unionByName(bridge), 150.0).select("cluster").distinct().count() == 1


def plain_rectangle(xy):
    """Diagonal of the smallest rectangle, trying the direction of every pair of points."""
    best = None
    for a in xy:
        for b in xy:
            d = math.hypot(b[0] - a[0], b[1] - a[1])
            if d > 0:
                u, v = (b[0] - a[0]) / d, (b[1] - a[1]) / d
                w, h = (max(s) - min(s) for s in ([p[0] * u + p[1] * v for p in xy], [p[1] * u - p[0] * v for p in xy]))
                if best is None or w * h < best[0] - 1e-6:
                    best = (w * h, math.hypot(w, h))
    return best[1] if best else 0.0


@pytest.mark.parametrize("seed", range(4))
def test_sliding_stops_against_whole_rectangles(spark, seed):
    """Stays along slanted lines, whose box along the axes says nothing."""
    rng = random.Random(seed)
    rows, t, y, x = [], datetime(2024, 1, 2, 8), 0.0, 0.0
    for _ in range(14):
        slant, calm = rng.uniform(0, math.pi), rng.random() < 0.6
        for _ in range(rng.randint(4, 14)):
            far = rng.uniform(0, 95 if rng.random() < 0.8 else 110) if calm else rng.uniform(100, 400)
            side = rng.uniform(0, 12)
            py, px = y + far * math.sin(slant) + side * math.cos(slant), x + far * math.cos(slant) - side * math.sin(slant)
            rows.append((1, len(rows), t, 48 + py * METRE, 2.0 + px * METRE / math.cos(math.radians(48))))
            t += timedelta(seconds=rng.randint(20, 90))
        y, x = y + rng.uniform(-500, 500), x + rng.uniform(-500, 500)
    want, w, stopped = [], [], False
    span = lambda a, b: (b[2] - a[2]).total_seconds()
    for p in rows:
        w.append(p)
        while not stopped and len(w) > 2 and span(w[0], w[-1]) >= 300:
            w.pop(0)
        now = len(w) > 1 and plain_rectangle([stops._planar(q[3], q[4], w[0][3]) for q in w]) < 100
        if stopped and not now and len(w) > 1 and span(w[0], w[-2]) >= 300:
            want.append((w[0][2], w[-2][2], median(q[3] for q in w[:-1]), median(q[4] for q in w[:-1])))
            w = []
        stopped = now
    if stopped and span(w[0], w[-1]) >= 300:
        want.append((w[0][2], w[-1][2], median(q[3] for q in w), median(q[4] for q in w)))
    got = stops.stops_sliding(spark.createDataFrame(rows, POINTS)).orderBy("start_time").collect()
    assert [(r.start_time, r.end_time) for r in got] == [x[:2] for x in want] and want
    assert all(r.lat == pytest.approx(x[2]) and r.lon == pytest.approx(x[3]) for r, x in zip(got, want, strict=True))


def test_cells_within_a_buffer(spark):
    """Against the nearest sites of a fine grid of places in the circle."""
    rng = random.Random(2)
    sites = [(i, rng.uniform(0, 100), rng.uniform(0, 100), i % 6) for i in range(40)]
    rows = [(i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(12)]
    of = spark.createDataFrame(sites, "site_id long, x double, y double, cluster_id long")
    got = {}
    for r in privacy.cells_within(spark.createDataFrame(rows, "pid long, x double, y double"), of, "pid", 9.0).collect():
        got.setdefault(r.pid, set()).add(r.cell)
    for i, x, y in rows:
        want, sure = set(), set()
        for a in range(-45, 46):
            for b in range(-45, 46):
                p, q = x + a / 5, y + b / 5
                far = math.hypot(p - x, q - y)
                if far <= 9.3:
                    cell = min((math.hypot(p - s, q - t), c) for _, s, t, c in sites)[1]
                    want.add(cell)
                    if far <= 9:
                        sure.add(cell)
        assert sure <= got[i] <= want | sure
    one = privacy.cells_within(spark.createDataFrame(rows[:1], "pid long, x double, y double"), of, "pid", 0.0)
    assert one.count() == 1


def test_cells_within_a_buffer_of_many_sites(spark):
    """Hundreds of sites in reach of each point, many points of one place, against the sites' cells cut by all others."""
    rng = random.Random(7)
    sites = [(i, rng.uniform(0, 100), rng.uniform(0, 100), i) for i in range(900)] + [(900, 50.0, 50.0, 900), (901, 50.0, 50.0, 901)]
    spots = [(50.0, 50.0), (20.0, 70.0), (99.0, 3.0)]
    rows = [(i, *spots[i % 3]) for i in range(60)]
    began = time.monotonic()
    got = {}
    for r in privacy.cells_within(spark.createDataFrame(rows, "pid long, x double, y double"), spark.createDataFrame(sites, "site_id long, x double, y double, cluster_id long"), "pid", 15.0).collect():
        got.setdefault(r.pid, set()).add(r.cell)
    assert time.monotonic() - began < 60  # all corners of all pairs of lines took hours
    for i, (x, y) in enumerate(spots):
        want = set()
        for k, sx, sy, _ in sites:
            corners = [(x - 15, y - 15), (x + 15, y - 15), (x + 15, y + 15), (x - 15, y + 15)]
            for _, ox, oy, _ in sites:
                u, v = ox - sx, oy - sy
                if (u or v) and corners:
                    corners = privacy._cut(corners, u, v, (ox * ox + oy * oy - sx * sx - sy * sy) / 2)
            if corners and (math.hypot(sx - x, sy - y) == min(math.hypot(a - x, b - y) for _, a, b, _ in sites) or privacy._off([(p - x, q - y) for p, q in corners]) <= 15):
                want.add(k)
        assert all(got[k] == want for k in range(i, 60, 3)) and len(want) > 20


def test_centroids_round_ties_by_the_product(spark):
    """Doubles at a tie of five decimals, and their neighbours, fall as pandas and DuckDB round them."""
    ties = [48.979975, 48.979974999999996, 48.849985, 48.849985000000004, 2.490165, 2.449915, -2.490165, 0.000005, -0.000005, 0.0]
    ties += [(10 * k + 5) / 1e6 for k in range(240_000, 240_200)]
    rows = [(1, "Home", x, -x) for x in ties] + [(1, "autre", 1.0, 1.0), (2, "Work", 2.490165, None), (2, "Work", 2.490169, None)]
    stops = spark.createDataFrame(rows, "participant_id long, place_type string, lat double, lon double")
    got = cluster.home_work_centroids(stops).collect()
    want = sorted({(round(x * 1e5) / 1e5, round(-x * 1e5) / 1e5) for x in ties})
    assert sorted((r.lat, r.lon) for r in got if r.participant_id == 1) == want
    assert [r.myid for r in sorted(got, key=lambda r: r.lat) if r.participant_id == 1] == list(range(1, len(want) + 1))
    assert [(r.myid, r.place_type, r.lat, r.lon) for r in got if r.participant_id == 2] == [(1, "Work", 2.49017, None)]


def test_wedges_over_several_cells_and_pieces(spark):
    """All sites of the end's cells count together, and pieces are cut at both ends."""
    t = datetime(2024, 1, 2)
    sites = spark.createDataFrame([(1, 0.0, 0.0, 1), (2, 0.0, 50.0, 2), (3, 200.0, 0.0, 3)], "site_id long, x double, y double, cluster_id long")
    rows = [("a", i, t + timedelta(minutes=i), i, 20.0 * i, 1.0) for i in range(1, 11)]
    traj = spark.createDataFrame(rows, "traj_id string, pos long, ts timestamp_ntz, event_id long, x double, y double")
    celled = privacy.cell_of_point(traj, sites, "event_id")
    two = spark.createDataFrame([("a", "start", 1), ("a", "start", 2), ("a", "end", 3)], "traj_id string, side string, cell long")
    got = {r.pos: r for r in privacy.conditions(celled, sites, 60.0, two).collect()}
    assert all(r.start_n == 2 and r.end_n == 1 for r in got.values()) and got[10].start_in is None and got[1].end_in is None
    assert [got[p].start_in for p in (1, 5, 9)] == [1, 2, 2] and [got[p].start_far for p in (1, 9)] == [False, True]
    stays = spark.createDataFrame([("a", t + timedelta(minutes=5), t + timedelta(minutes=6))], "traj_id string, start_ts timestamp_ntz, end_ts timestamp_ntz")
    out = privacy.truncate_at_stays(celled, stays, sites).collect()
    assert {r.traj_id for r in out} <= {"a"} and all(r.event_id < 6 if r.piece == 0 else r.event_id > 5 for r in out)
    assert privacy.truncate_at_stays(celled, stays, sites, buffer=30.0).count() <= 10


@pytest.fixture
def met(monkeypatch):
    """Tables that wedges make, by name."""
    made = {}

    def durable(df, name, real=privacy.durable):
        made[name] = real(df, name)
        return made[name]

    monkeypatch.setattr(privacy, "durable", durable)
    return made


def walks(spark, n=40, sites=600):
    rng = random.Random(12)
    t = datetime(2024, 1, 2)
    of = spark.createDataFrame([(k, rng.uniform(0, 1000), rng.uniform(0, 1000), 1 + k % 2) for k in range(sites)], "site_id long, x double, y double, cluster_id long")
    rows = [(name, i, t + timedelta(minutes=i), 100 * j + i, rng.uniform(-3000, 4000), rng.uniform(-3000, 4000)) for j, name in enumerate("ab") for i in range(1, n + 1)]
    traj = spark.createDataFrame(rows, "traj_id string, pos long, ts timestamp_ntz, event_id long, x double, y double")
    return privacy.cell_of_point(traj, of, "event_id"), of


def plain_cut(points, sites):
    """Points between the first and the last that may be a cut, of one piece."""
    def clear(p, q, cell):
        if q is None:
            return False
        d = math.degrees(math.atan2(p.y - q.y, p.x - q.x)) % 360
        apart = [abs(math.degrees(math.atan2(s.y - p.y, s.x - p.x)) % 360 - d) for s in sites if s.cluster_id == cell]
        return sum(a <= 30 or 360 - a <= 30 for a in apart) in (0, len(apart))

    first, last = points[0].cell, points[-1].cell
    a = [k for k, p in enumerate(points) if p.cell != first and clear(p, points[k + 1] if k + 1 < len(points) else None, first)]
    b = [k for k, p in enumerate(points) if p.cell != last and clear(p, points[k - 1] if k else None, last)]
    return [p.event_id for p in points[a[0] : b[-1] + 1]] if a and b and a[0] < b[-1] else []


def test_truncate_meets_a_row_a_wedge(spark, met):
    celled, of = walks(spark)
    got = sorted(r.event_id for r in privacy.truncate(celled, of).collect())
    rows, sites = celled.orderBy("traj_id", "pos").collect(), of.collect()
    assert got == sorted(e for name in "ab" for e in plain_cut([r for r in rows if r.traj_id == name], sites)) and got
    assert met["wedges"].count() <= 2 * 80


def test_pieces_meet_a_row_a_wedge(spark, met):
    celled, of = walks(spark)
    t = datetime(2024, 1, 2)
    stays = spark.createDataFrame([("a", t + timedelta(minutes=15), t + timedelta(minutes=20)), ("b", t + timedelta(minutes=30), t + timedelta(minutes=31))], "traj_id string, start_ts timestamp_ntz, end_ts timestamp_ntz")
    got = sorted(r.event_id for r in privacy.truncate_at_stays(celled, stays, of).collect())
    rows, sites = celled.orderBy("traj_id", "pos").collect(), of.collect()
    pieces = [[r for r in rows if r.traj_id == name and low <= r.pos <= high] for name, low, high in (("a", 1, 15), ("a", 20, 40), ("b", 1, 30), ("b", 31, 40))]
    assert got == sorted(e for p in pieces for e in plain_cut(p, sites)) and got
    assert met["wedges"].count() <= 2 * 80
