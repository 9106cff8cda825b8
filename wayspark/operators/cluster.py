"""Clustering stops by distance, grouping them in time, and merging close ones.

Stops have participant_id, stop_seq (unique per participant), start_time, end_time,
duration_s, lat, lon.

No clustering compares all stops of a place. A cell whose diagonal is at most the distance
is one node, however many stops it holds; two cells are linked as soon as one pair of their
boxes is known to be near enough, and boxes are parted only where that isn't known yet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec

from wayspark.functions.durable import durable, release
from wayspark.functions.geo import MOST_M, Grid, cell, geodesic_m, haversine_m
from wayspark.operators.components import components
from wayspark.operators.joins import inside
from wayspark.operators.points import micros

#: In each round, boxes are parted so many times along both axes (a power of 2).
PARTED = 4
#: The row of a stop without a place; its stop_seq is the column.
NOWHERE = -(1 << 62)


def by_start() -> WindowSpec:
    return W.partitionBy("participant_id").orderBy("start_time", "stop_seq")


def _grid(metres: float) -> Grid:
    """Cells whose diagonal is at most ``metres``."""
    return Grid(metres, 2**0.5 * (1 + 1e-9))


def _in_cells(stops: DataFrame, grid: Grid) -> DataFrame:
    """Adds _i and _j, the cell of each stop."""
    known = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    i, j = grid.of(F.col("lat"), F.col("lon"))
    return stops.withColumns({"_i": F.when(known, i).otherwise(NOWHERE), "_j": F.when(known, j).otherwise(F.col("stop_seq"))})


_BOX = ["min_lat", "max_lat", "min_lon", "max_lon"]


def _extent() -> list[Column]:
    return [f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("lat", "lon")]


def _apart(distance: Callable[..., Column], metres: float) -> tuple[Column, Column]:
    """Whether all of the boxes a_ and b_ are within ``metres``, and whether any of them may be.

    Between their middles lies the distance of any two of their places, up to both radii;
    for boxes that are single places it is exact.
    """
    middle = lambda s, c: (F.col(f"{s}_min_{c}") + F.col(f"{s}_max_{c}")) / 2

    def radius(s: str) -> Column:
        half = lambda c: (F.col(f"{s}_max_{c}") - F.col(f"{s}_min_{c}")) / 2 * MOST_M
        inner = F.when(F.col(f"{s}_min_lat") * F.col(f"{s}_max_lat") <= 0, 0.0).otherwise(F.least(F.abs(f"{s}_min_lat"), F.abs(f"{s}_max_lat")))
        return F.hypot(half("lat"), half("lon") * F.cos(F.radians(inner)))

    between = distance(middle("a", "lat"), middle("a", "lon"), middle("b", "lat"), middle("b", "lon"))
    both = (radius("a") + radius("b")) * (1 + 1e-6)
    return between + both <= metres, between - both <= metres


def cell_links(stops: DataFrame, nodes: DataFrame, grid: Grid, distance: Callable[..., Column], allowed: Column) -> DataFrame:
    """u, v: the nodes (cells) that have a pair of stops within ``grid.metres``; once each.

    ``stops`` have their node, ``nodes`` their cell, extent and _kind; ``allowed`` is a
    condition on a__kind and b__kind. Every round decides on pairs of boxes, and those left
    open are parted into those of the next; pairs of linked nodes aren't looked at again.
    """
    side = lambda df, s, more=(): df.select(*(F.col(c).alias(f"{s}_{c}") for c in ("node", *_BOX, *more)))
    placed = nodes.where(F.col("_i") > NOWHERE)
    at = F.explode(grid.around(F.col("_i"), F.col("min_lon"), F.col("max_lon")))
    left = side(placed.withColumn("c", at).withColumns({"ni": F.col("c.i"), "nj": F.col("c.j")}), "a", ("participant_id", "_i", "_j", "_kind", "ni", "nj"))
    right = side(placed, "b", ("participant_id", "_i", "_j", "_kind"))
    on = (F.col("a_participant_id") == F.col("b_participant_id")) & (F.col("a_ni") == F.col("b__i")) & (F.col("a_nj") == F.col("b__j")) & (F.col("a_node") < F.col("b_node"))
    same = (F.col("a__i") == F.col("b__i")) & (F.col("a__j") == F.col("b__j"))
    near, maybe = _apart(distance, grid.metres)
    rows = left.join(right, on).where(allowed).withColumns({"near": same | near, "maybe": maybe}).where("near or maybe")
    index = ("i", "j")
    rows = durable(rows.select(F.col("a_node").alias("u"), F.col("b_node").alias("v"), *(F.col(f"{s}__{c}").alias(f"{s}_{c}") for s in "ab" for c in index), "near"), "boxes")
    links, scale = rows.where("near").select("u", "v").distinct(), 1
    places = stops.where(F.col("_i") > NOWHERE).select("node", "lat", "lon").distinct()
    while not (open_ := rows.where("not near").join(links, ["u", "v"], "left_anti")).isEmpty():
        scale *= PARTED
        i, j = grid.of(F.col("lat"), F.col("lon"), scale)
        parts = places.withColumns({"i": i, "j": j}).groupBy("node", "i", "j").agg(*_extent())
        for s, node in (("a", "u"), ("b", "v")):
            up = lambda c: F.floor(F.col(f"_{c}") / PARTED).cast("long") if scale < 1 << 40 else F.col(f"_{c}")
            part = parts.select(F.col("node").alias(node), F.col("i").alias("_i"), F.col("j").alias("_j"), *(F.col(c).alias(f"{s}_{c}") for c in _BOX)).withColumns({f"{s}_{c}": up(c) for c in index})
            open_ = open_.join(part, [node, f"{s}_i", f"{s}_j"]).drop(f"{s}_i", f"{s}_j").withColumnsRenamed({"_i": f"{s}_i", "_j": f"{s}_j"})
        found = durable(open_.withColumns({"near": near, "maybe": maybe}).where("near or maybe").select("u", "v", *(f"{s}_{c}" for s in "ab" for c in index), "near"), "boxes")
        links = durable(links.unionByName(found.where("near").select("u", "v").distinct()), "links")
        rows = found
    return links


def _rooted(stops: DataFrame, metres: float, distance: Callable[..., Column], kind: Column | None = None) -> DataFrame:
    """Adds ``root``, the smallest stop_seq of each stop's component under links of at most ``metres``.

    Stops of kinds 1 and 2 aren't linked to each other. Stops without a place are alone.
    """
    grid = _grid(metres)
    by = ["participant_id", "_kind", "_i", "_j"]
    celled = durable(_in_cells(stops.withColumn("_kind", (kind if kind is not None else F.lit(0)).cast("int")), grid), "cells")
    # numbered once: written before anything reads them
    nodes = durable(celled.groupBy(*by).agg(F.min("stop_seq").alias("first"), *_extent()).withColumn("node", F.monotonically_increasing_id()), "nodes")
    named = durable(celled.join(nodes.select(*by, "node"), by), "named")
    roots = components(cell_links(named, nodes, grid, distance, F.col("a__kind") + F.col("b__kind") != 3)).withColumnRenamed("root", "_root")
    owned = nodes.select("node", "first").join(roots, "node", "left").withColumn("_root", F.coalesce("_root", "node"))
    owned = durable(owned, "owned")
    least = owned.groupBy("_root").agg(F.min("first").alias("root"))
    release(celled)
    return named.join(owned.join(least, "_root").select("node", "root"), "node").drop("node", "_root", *by[1:])


def _labels(rooted: DataFrame) -> DataFrame:
    """``cluster``: components numbered from 0 by their first stop."""
    numbers = rooted.select("participant_id", "root").distinct().withColumn("cluster", F.row_number().over(W.partitionBy("participant_id").orderBy("root")).cast("long") - 1)
    return rooted.join(numbers, ["participant_id", "root"]).drop("root")


def dbscan(stops: DataFrame, eps_m: float = 150.0, min_samples: int = 1) -> DataFrame:
    """Adds ``cluster``: -1 for noise, else numbered from 0 by the first core stop.

    Core stops have ``min_samples`` stops within ``eps_m``, themselves included. A border
    stop joins the smallest cluster among its core neighbours.
    """
    if min_samples <= 1:
        return _labels(_rooted(stops, eps_m, haversine_m))
    key, grid = ["participant_id", "stop_seq"], _grid(eps_m)
    celled = durable(_in_cells(stops.select(*key, "lat", "lon"), grid), "cells")
    sizes = celled.groupBy("participant_id", "_i", "_j").agg(F.count("*").alias("_n"))
    counted = durable(celled.join(sizes, ["participant_id", "_i", "_j"]), "counted")
    # a cell of min_samples stops has only cores; others have fewer, so theirs are few pairs
    sparse = durable(counted.where((F.col("_n") < min_samples) & (F.col("_i") > NOWHERE)).drop("_n"), "sparse")

    def beside(rows: DataFrame, others: DataFrame) -> DataFrame:
        """The stops of ``rows`` with all of ``others`` (stops in cells) within the distance: ``other`` and its columns."""
        spread = rows.withColumn("_c", F.explode(grid.around(F.col("_i"), F.col("lon"), F.col("lon")))).select(*key, F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.col("_c.i").alias("_i"), F.col("_c.j").alias("_j"))
        return spread.join(others.withColumnRenamed("stop_seq", "other"), ["participant_id", "_i", "_j"]).where(haversine_m(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")) <= eps_m)

    more = beside(sparse, celled).groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") >= min_samples).select(*key)
    cores = durable(counted.where(F.col("_n") >= min_samples).select(*key).unionByName(more), "cores")
    labelled = durable(_labels(_rooted(celled.join(cores, key, "left_semi").select(*key, "lat", "lon"), eps_m, haversine_m)), "clusters")
    near = beside(sparse.join(cores, key, "left_anti"), _in_cells(labelled, grid)).groupBy(*key).agg(F.min("cluster").alias("near"))
    return (
        stops.join(labelled.select(*key, F.col("cluster").alias("own")), key, "left").join(near, key, "left")
        .withColumn("cluster", F.coalesce("own", "near", F.lit(-1).cast("long"))).drop("own", "near")
    )


def cluster_stops(clustered: DataFrame) -> DataFrame:
    """One stop for each cluster: first start, last end, summed duration, mean place, size."""
    return clustered.where("cluster >= 0").groupBy("participant_id", "cluster").agg(
        F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.sum("duration_s").alias("duration_s"),
        F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count("*").alias("group_size"),
    )


def points_in_stops(points: DataFrame, stops: DataFrame) -> DataFrame:
    """Points within the times of any stop, each once."""
    return inside(points, stops, "participant_id", "ts", "start_time", "end_time")


def group_stops(stops: DataFrame, max_gap_s: float = 600.0, max_distance_m: float = 200.0) -> DataFrame:
    """Neighbours in time that are close in time and space become one stop.

    A stop joins the one before if it starts at most ``max_gap_s`` after that ends (overlaps
    pass) at most ``max_distance_m`` away.
    """
    gap = (micros(F.col("start_time")) - micros(F.lag("end_time").over(by_start()))) / 1_000_000
    apart = geodesic_m(F.lag("lat").over(by_start()), F.lag("lon").over(by_start()), F.col("lat"), F.col("lon"))
    new = F.when((gap <= max_gap_s) & (apart <= max_distance_m), 0).otherwise(1)
    return (
        stops.withColumn("_new", new).withColumn("_g", F.sum("_new").over(by_start())).groupBy("participant_id", "_g").agg(
            F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.sum("duration_s").alias("duration_s"),
            F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count("*").alias("group_size"),
        ).drop("_g")
    )


def close_stops(stops: DataFrame, max_distance_m: float = 150.0) -> DataFrame:
    """Adds ``root``: stops linked by steps of at most ``max_distance_m`` share it; Home and Work never link directly."""
    kind = F.when(F.col("place_type") == "Home", 1).when(F.col("place_type") == "Work", 2).otherwise(0)
    return _rooted(stops, max_distance_m, geodesic_m, kind)


def merge_close_stops(stops: DataFrame, max_distance_m: float = 150.0) -> DataFrame:
    """Stops of a root become one; the strongest type of a group (Home, Work, other) is its type.

    Its visits are the rows of :func:`close_stops`, one each, so no group is collected.
    """
    rank = F.when(F.col("place_type") == "Home", 2).when(F.col("place_type") == "Work", 1).otherwise(0)
    return close_stops(stops, max_distance_m).groupBy("participant_id", "root").agg(
        F.max_by("place_type", F.struct(rank, -F.col("stop_seq"))).alias("place_type"), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"),
        F.sum("duration_s").alias("duration_s"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count("*").alias("group_size"),
    )


def home_work_centroids(stops: DataFrame) -> DataFrame:
    """myid (from 1), participant_id, place_type, lat and lon to five decimals of Home and Work.

    They are rounded as pandas and DuckDB do, by the product with 1e5. bround takes the digits
    that a double prints as, so it finds a tie in 2.490165, whose product is above a half.
    """
    to_five = lambda c: (F.rint(F.col(c) * 1e5) / 1e5).alias(c)
    rounded = stops.where(F.col("place_type").isin("Home", "Work")).select("participant_id", "place_type", to_five("lat"), to_five("lon")).distinct()
    order = W.partitionBy("participant_id").orderBy("place_type", "lat", "lon")
    return rounded.select(F.row_number().over(order).cast("long").alias("myid"), "participant_id", "place_type", "lat", "lon")
