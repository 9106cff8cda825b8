"""Joins by time interval and by distance, as equi-joins on buckets with an exact check.

No pair is formed but those that share a bucket, so the work follows the density of the
data in time and space rather than the product of both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayspark.functions.durable import durable
from wayspark.functions.geo import Grid, around, cell
from wayspark.operators import quadtree

#: Width of the time buckets.
BUCKET_S = 6 * 3600


def _seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1_000_000


def interval_pairs(points: DataFrame, intervals: DataFrame, key: str, ts: str, start: str, end: str, bucket_s: int = BUCKET_S) -> DataFrame:
    """Points and the intervals that contain them, both ends included.

    Column names of the two sides must differ except for ``key``. Rows with a null time
    match nothing.
    """
    bucket = cell(_seconds(F.col(ts)), bucket_s)
    spans = intervals.where(F.col(start) <= F.col(end)).withColumn("_b", F.explode(F.sequence(cell(_seconds(F.col(start)), bucket_s), cell(_seconds(F.col(end)), bucket_s))))
    return points.withColumn("_b", bucket).join(spans, [key, "_b"]).where(F.col(ts).between(F.col(start), F.col(end))).drop("_b")


def inside(points: DataFrame, intervals: DataFrame, key: str, ts: str, start: str, end: str, keep: bool = True, bucket_s: int = BUCKET_S) -> DataFrame:
    """Points inside any interval (``keep``) or inside none, each once."""
    spans = intervals.where(F.col(start) <= F.col(end)).select(
        F.col(key).alias("_k"), F.col(start).alias("_s"), F.col(end).alias("_e"),
        F.explode(F.sequence(cell(_seconds(F.col(start)), bucket_s), cell(_seconds(F.col(end)), bucket_s))).alias("_b"),
    )
    on = (F.col(key) == F.col("_k")) & (cell(_seconds(F.col(ts)), bucket_s) == F.col("_b")) & F.col(ts).between(F.col("_s"), F.col("_e"))
    return points.join(spans, on, "left_semi" if keep else "left_anti")


def within_radius(left: DataFrame, right: DataFrame, metres: float, distance: Callable[..., Column], key: str | None, at: tuple[str, str], to: tuple[str, str], planar: bool = False) -> DataFrame:
    """Pairs within ``metres`` of each other, with ``dist_m``.

    ``at`` and ``to`` name latitude and longitude (planar: y and x) on each side; other
    names must differ except for ``key``. Cells are about ``metres`` wide, so the right side
    is looked for in the cells around. Places with a null coordinate are near nothing.
    """
    if planar:
        cells, spread = [cell(F.col(c), metres) for c in at], right
        for name, c in zip(("_i", "_j"), to, strict=True):
            spread = spread.withColumn(name, F.explode(around(cell(F.col(c), metres))))
    else:
        grid = Grid(metres)
        cells, lon = grid.of(F.col(at[0]), F.col(at[1])), F.col(to[1])
        spread = right.where(F.col(to[0]).isNotNull() & lon.isNotNull()).withColumn("_c", F.explode(grid.around(cell(F.col(to[0]), grid.side), lon, lon)))
        spread = spread.withColumns({"_i": F.col("_c.i"), "_j": F.col("_c.j")}).drop("_c")
    pairs = left.withColumn("_i", cells[0]).withColumn("_j", cells[1]).join(spread, [*([key] if key else []), "_i", "_j"]).drop("_i", "_j")
    return pairs.withColumn("dist_m", distance(*map(F.col, (*at, *to)))).where(F.col("dist_m") <= metres)


def nearest(points: DataFrame, sites: DataFrame, at: tuple[str, str], to: tuple[str, str], pid: str, pick: list[str], distance: Callable[..., Column]) -> DataFrame:
    """Each point (unique ``pid``) with the columns ``pick`` of its nearest site, and ``dist``.

    Planar. Ties go to the smallest ``pick``. Places go down a quadtree of the sites, each once
    however many points it has. Points with a null coordinate, and all if there are no sites,
    get nulls.
    """
    tree = quadtree.build(sites, to[1], to[0], pick)
    if tree is None:
        return points.select("*", *(F.lit(None).cast(sites.schema[c].dataType).alias(c) for c in pick), F.lit(None).cast("double").alias("dist"))
    places = durable(points.select(*at).where(F.col(at[0]).isNotNull() & F.col(at[1]).isNotNull()).distinct(), "at")
    found = quadtree.knn(places, tree, list(at), at, to, pick, distance).drop("rank").withColumnRenamed("dist_m", "dist")
    return points.join(found, list(at), "left").select(*points.columns, *pick, "dist")
