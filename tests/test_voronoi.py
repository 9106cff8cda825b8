"""Cells, Delaunay edges and merged cells against all circles, sums of areas and nearest sites."""

import math
import random

import pytest

from wayspark.operators import voronoi

SITES = "site_id long, x double, y double"


def envelope(sites):
    xs, ys = [s[1] for s in sites], [s[2] for s in sites]
    m = max(max(xs) - min(xs), max(ys) - min(ys)) or 1.0
    return min(xs) - m, min(ys) - m, max(xs) + m, max(ys) + m


def brute_edges(sites):
    """Pairs with a stretch of centres, in the envelope, of circles through both that hold no other site."""
    x0, y0, x1, y1 = envelope(sites)
    out = set()
    for i, ax, ay in sites:
        for j, bx, by in sites:
            if i >= j:
                continue
            d = math.hypot(bx - ax, by - ay)
            mx, my, ux, uy = (ax + bx) / 2, (ay + by) / 2, -(by - ay) / d, (bx - ax) / d
            lo, hi = -math.inf, math.inf
            for k, cx, cy in sites:
                if k not in (i, j):
                    q, g = (mx - cx) ** 2 + (my - cy) ** 2 - (d / 2) ** 2, 2 * (ux * (ax - cx) + uy * (ay - cy))
                    if abs(g) < 1e-9:
                        hi = hi if q >= 0 else -math.inf
                    elif g > 0:
                        lo = max(lo, -q / g)
                    else:
                        hi = min(hi, -q / g)
            for m, u, a, b in ((mx, ux, x0, x1), (my, uy, y0, y1)):
                if abs(u) > 1e-12:
                    lo, hi = max(lo, min((a - m) / u, (b - m) / u)), min(hi, max((a - m) / u, (b - m) / u))
            if hi - lo > 1e-6:
                out.add((i, j))
    return out


def inside(ring, x, y):
    return all((b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) >= -1e-6 for a, b in zip(ring, ring[1:] + ring[:1], strict=True))


def scattered(seed, n):
    rng = random.Random(seed)
    return [(i, rng.uniform(0, 1000), rng.uniform(0, 700)) for i in range(n)]


def in_one_spot(n):
    rng = random.Random(9)
    return [(i, rng.uniform(0, 1), rng.uniform(0, 1)) if i % 10 else (i, rng.uniform(0, 1000), rng.uniform(0, 1000)) for i in range(n)]


SHAPES = {
    "scattered": scattered(1, 120),
    "spot": in_one_spot(80),
    "hub": [(0, 0.0, 0.0)] + [(k, 100 * math.cos(k * 0.13) * (1 + k / 1e4), 100 * math.sin(k * 0.13) * (1 + k / 1e4)) for k in range(1, 49)],
    "grid": [(8 * i + j, 10.0 * i, 10.0 * j) for i in range(8) for j in range(8)],
    "row": [(k, 7.0 * k + k * k, 0.0) for k in range(12)],
    "two": [(4, 0.0, 0.0), (9, 1.0, 2.0)],
    "one": [(4, 3.0, 3.0)],
}


@pytest.mark.parametrize("name", SHAPES)
def test_against_all_circles(spark, name):
    sites = SHAPES[name]
    shapes = voronoi.cells(spark.createDataFrame(sites, SITES))
    got = {(r.source, r.target): r.length for r in voronoi.delaunay_edges(shapes).collect()}
    assert set(got) == brute_edges(sites)
    at = {i: (x, y) for i, x, y in sites}
    assert all(length == pytest.approx(math.dist(at[a], at[b])) for (a, b), length in got.items())
    rows = shapes.collect()
    x0, y0, x1, y1 = envelope(sites)
    assert sorted(r.site_id for r in rows) == sorted(at) and sum(r.area for r in rows) == pytest.approx((x1 - x0) * (y1 - y0))
    rings = {r.site_id: [(r.x + s.x, r.y + s.y) for s in r.sides] for r in rows}
    rng = random.Random(3)
    for _ in range(300):
        x, y = rng.uniform(x0, x1), rng.uniform(y0, y1)
        assert inside(rings[min(sites, key=lambda s: math.dist(s[1:], (x, y)))[0]], x, y)


def test_greedy_clusters_need_no_other_edges(spark):
    sites = SHAPES["scattered"]
    edges = sorted((r.length, r.source, r.target) for r in voronoi.delaunay_edges(voronoi.cells(spark.createDataFrame(sites, SITES))).collect())

    def greedy(edges, k):
        own = {s[0]: s[0] for s in sites}
        for _, a, b in edges:
            na, nb = (sum(v == own[c] for v in own.values()) for c in (a, b))
            if own[a] != own[b] and min(na, nb) < k:
                old, new = (own[b], own[a]) if na >= nb else (own[a], own[b])
                own = {s: new if c == old else c for s, c in own.items()}
        return own

    every = sorted((math.dist(a[1:], b[1:]), a[0], b[0]) for a in sites for b in sites if a[0] < b[0])
    assert greedy(edges, 4) == greedy(every, 4)


def test_merged_cells(spark):
    sites = SHAPES["grid"]
    frame = spark.createDataFrame(sites, SITES)
    shapes = voronoi.cells(frame)
    halves = frame.selectExpr("site_id", "int(x >= 40) as cluster_id")
    got = {r.cluster_id: r for r in voronoi.merged_cells(shapes, halves).collect()}
    assert {c: (r.n_cells, round(r.area, 6), round(r.boundary, 6)) for c, r in got.items()} == {c: (32, 105 * 210.0, 2 * (105 + 210.0)) for c in (0, 1)}
    line = [r for r in voronoi.boundaries(shapes, halves).collect() if r.cluster_id == 0 and r.beyond == 1]
    assert {round(r.x0, 6) for r in line} == {35.0} and sum(r.length for r in line) == pytest.approx(210)


def test_equal_places_and_places_without_numbers(spark):
    rows = [(5, 1.0, 1.0), (3, 1.0, 1.0), (7, 4.0, 1.0), (8, None, 1.0), (9, float("nan"), 1.0), (10, float("inf"), 1.0)]
    shapes = voronoi.cells(spark.createDataFrame(rows, SITES))
    assert [tuple(r) for r in voronoi.delaunay_edges(shapes).collect()] == [(3, 7, 3.0)]
    assert {r.site_id for r in shapes.collect()} == {3, 7}
    wkt = {r.site_id: r.wkt for r in voronoi.as_wkt(shapes).collect()}
    assert wkt[3].startswith("POLYGON ((") and wkt[3].count(",") == 4


def test_nothing(spark):
    shapes = voronoi.cells(spark.createDataFrame([], SITES))
    assert shapes.count() == voronoi.delaunay_edges(shapes).count() == 0
