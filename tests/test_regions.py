"""Points in many regions, against every ring."""

import math
import random

from wayspark.operators import regions


def inside(x, y, ring):
    hit = False
    for a, b in zip(ring, ring[1:] + ring[:1]):
        if (a[1] > y) != (b[1] > y) and x < a[0] + (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]):
            hit = not hit
    return hit


def frames(spark, points, rings):
    return (
        spark.createDataFrame(points, "id long, x double, y double").repartition(2),
        spark.createDataFrame([(k, None if r is None else [{"x": x, "y": y} for x, y in r]) for k, r in enumerate(rings)], "region_id long, ring array<struct<x double, y double>>"),
    )


def test_stars_of_all_sizes(spark):
    rng = random.Random(1)
    rings = []
    for k in range(60):
        cx, cy, size = rng.uniform(-500, 500), rng.uniform(-500, 500), 10 ** rng.uniform(-1, 2.5)
        n = rng.randrange(3, 12)
        rings.append([(cx + size * rng.uniform(0.2, 1) * math.cos(2 * math.pi * i / n), cy + size * rng.uniform(0.2, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)])
    rings += [None, [], [(1.0, None), (2.0, 2.0), (3.0, 0.0)], [(5.0, 5.0)], [(0.0, 0.0), (9.0, 9.0)], [(0.0, 0.0), (0.0, 64.0), (64.0, 64.0), (64.0, 0.0)]]
    points = [(k, rng.uniform(-600, 600), rng.uniform(-600, 600)) for k in range(300)] + [(1000 + k, *rings[k][0]) for k in range(60)]
    points += [(2000 + k, 4.0 * k, 16.0) for k in range(20)] + [(3000, None, 1.0), (3001, 1.0, None)]
    got = {tuple(r) for r in regions.in_regions(*frames(spark, points, rings), "id").collect()}
    whole = [(k, r) for k, r in enumerate(rings) if r and all(v is not None for p in r for v in p)]
    assert got == {(i, k) for i, x, y in points if x is not None and y is not None for k, r in whole if inside(x, y, r)}


def test_most_cells_need_no_ring(spark):
    _, square = frames(spark, [(1, 0.0, 0.0)], [[(0.5, 0.5), (0.5, 1000.5), (1000.5, 1000.5), (1000.5, 0.5)]])
    cells = regions.coverings(square)
    assert cells.where("whole").count() > 0.6 * cells.count() and cells.count() < 40**2


def test_places_are_looked_up_once_and_only_their_cells_tested(spark, monkeypatch):
    """Many points of few places: regions meet places, not points, and cells without a place are not covered."""
    made = {}

    def durable(df, name, real=regions.durable):
        made[name] = real(df, name)
        return made[name]

    monkeypatch.setattr(regions, "durable", durable)
    rng = random.Random(4)
    rings = [[(x, y), (x + 40.0, y + 90.0), (x + 90.0, y)] for x, y in ((rng.uniform(0, 300), rng.uniform(0, 300)) for _ in range(40))]
    spots = [(rng.uniform(50, 350), rng.uniform(50, 350)) for _ in range(7)]
    points = [(k, *spots[k % 7]) for k in range(700)]
    got = [tuple(r) for r in regions.in_regions(*frames(spark, points, rings), "id").collect()]
    want = {(i, k) for i, x, y in points for k, r in enumerate(rings) if inside(x, y, r)}
    assert set(got) == want and len(got) == len(want) > 700
    assert made["coverings"].count() <= 40 * 7


def test_nothing(spark):
    points, none = frames(spark, [(1, 0.0, 0.0)], [None])
    assert regions.in_regions(points, none, "id").count() == 0
