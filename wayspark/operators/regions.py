"""Points in any number of regions, by coverings of the regions with cells.

A region (region_id, ring: array of structs x, y, not closed) is covered by cells of a size
that fits it, a power of two, some PIECES across. A cell that no edge of the ring touches is
inside or outside as a whole; only points in the others are tested against the ring. So the
join is an equi-join on cells, whatever the number and the sizes of regions, and few points
meet a ring. Only cells with a point are tested for edges, and a place is looked up once,
however many points it has. Works in the plane.

A null or empty ring, or one with a null coordinate, holds nothing; neither is a point with a
null coordinate in any region. Points on an edge are those that ray casting counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayspark.functions.durable import durable
from wayspark.operators.privacy import in_ring

#: Cells across the longer side of a region's box, at least.
PIECES = 16


def _edges(ring: Column) -> Column:
    n = F.size(ring)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.element_at(ring, i).alias("a"), F.element_at(ring, i % n + 1).alias("b")))


def _touches(edge: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether an edge meets the box: their extents overlap, and the box has corners on both sides of the edge's line."""
    ax, ay, bx, by = edge["a"]["x"], edge["a"]["y"], edge["b"]["x"], edge["b"]["y"]
    beside = lambda x, y: (bx - ax) * (y - ay) - (by - ay) * (x - ax)
    corners = [beside(x, y) for x in (x0, x1) for y in (y0, y1)]
    overlap = (F.greatest(ax, bx) >= x0) & (F.least(ax, bx) <= x1) & (F.greatest(ay, by) >= y0) & (F.least(ay, by) <= y1)
    return overlap & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0)


def _sound(regions: DataFrame, pieces: int) -> DataFrame:
    """Regions that can hold a point, with their box, ``level`` and the width of their cells."""
    places = F.col("ring")
    sound = regions.where(places.isNotNull() & (F.size(places) > 0) & F.forall(places, lambda p: p["x"].isNotNull() & p["y"].isNotNull()))
    of = lambda f, c: f(F.transform(places, lambda p: p[c]))
    boxed = sound.select("region_id", "ring", *(of(f, c).alias(f"_{n}{c}") for c in "xy" for n, f in (("lo", F.array_min), ("hi", F.array_max))))
    longest = F.greatest(F.col("_hix") - F.col("_lox"), F.col("_hiy") - F.col("_loy"), F.lit(1e-9))
    return boxed.withColumn("level", F.floor(F.log2(longest / pieces)).cast("int")).withColumn("_w", F.pow(F.lit(2.0), F.col("level")))


def coverings(regions: DataFrame, pieces: int = PIECES, held: DataFrame | None = None) -> DataFrame:
    """region_id, level, i, j and ``whole`` (inside as a whole) of the cells that each region meets; only those in ``held`` (level, i, j), if given."""
    boxed, places = _sound(regions, pieces), F.col("ring")
    number = lambda c: F.floor(F.col(c) / F.col("_w")).cast("long")
    cells = boxed.withColumn("i", F.explode(F.sequence(number("_lox"), number("_hix")))).withColumn("j", F.explode(F.sequence(number("_loy"), number("_hiy"))))
    if held is not None:
        mine = cells.select("region_id", "level", "i", "j").join(held, ["level", "i", "j"], "left_semi")
        cells = mine.join(boxed.drop("level"), "region_id")
    slack = F.col("_w") * 1e-6
    x0, y0 = F.col("i") * F.col("_w"), F.col("j") * F.col("_w")
    border = F.exists(_edges(places), lambda e: _touches(e, x0 - slack, y0 - slack, x0 + F.col("_w") + slack, y0 + F.col("_w") + slack))
    found = cells.withColumn("_border", border).withColumn("whole", ~F.col("_border") & in_ring(x0 + F.col("_w") / 2, y0 + F.col("_w") / 2, places))
    return found.where("_border or whole").select("region_id", "level", "i", "j", "whole")


def in_regions(points: DataFrame, regions: DataFrame, pid: str, pieces: int = PIECES) -> DataFrame:
    """pid and region_id for every point (unique ``pid``, x, y) and region that holds it."""
    levels = [r[0] for r in _sound(regions, pieces).select("level").distinct().collect()]  # one for each power of two of the sizes
    if not levels:
        return points.select(pid, F.lit(None).cast(regions.schema["region_id"].dataType).alias("region_id")).limit(0)
    at = lambda k: F.struct(F.lit(k).alias("level"), F.floor(F.col("x") / 2.0**k).cast("long").alias("i"), F.floor(F.col("y") / 2.0**k).cast("long").alias("j"))
    places = durable(points.where("x is not null and y is not null").select("x", "y").distinct(), "places")
    placed = places.select("x", "y", F.explode(F.array(*map(at, levels))).alias("_c")).select("x", "y", "_c.*")
    cells = durable(coverings(regions, pieces, placed.select("level", "i", "j").distinct()), "coverings")
    met = durable(placed.join(cells, ["level", "i", "j"]).select("x", "y", "region_id", "whole"), "met")
    rings = regions.select("region_id", "ring")
    tested = met.where("not whole").join(rings, "region_id").where(in_ring(F.col("x"), F.col("y"), F.col("ring")))
    found = met.where("whole").select("x", "y", "region_id").unionByName(tested.select("x", "y", "region_id"))
    # a row of few bytes may lie in many regions, so the rows' size must not set the number of tasks
    dealt = points.select(pid, "x", "y").repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), "x", "y")
    return dealt.join(found.groupBy("x", "y").agg(F.collect_list("region_id").alias("_in")), ["x", "y"]).select(pid, F.explode("_in").alias("region_id"))
