"""Cells of sites as polygons, the Delaunay edges between them, and cells merged by cluster.

A site's cell is the envelope cut by the half planes towards some other sites. It is right
as soon as no corner of it is nearer to a site that it wasn't cut by: a half plane that cuts
a convex cell cuts off a corner. So cells start from each site's nearest sites; corners look
for their nearest site by the quadtree; what they find cuts the cell again, in rounds over
the cells that are still open. A corner is the centre of a circle through sites, so this is
the test for empty circumcircles. No tile is ever triangulated in one task, and a cell's
rows are its own sides only.

Planar: sites have site_id, x, y. Of several at one place the smallest id owns the cell;
those without a finite place have none. The envelope is the sites' box, widened by the
larger of its sides: so neighbours whose common side lies wholly outside it count as none.
Those are long edges of the convex hull, never the shortest way out of a cluster.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayspark.functions.durable import durable, release
from wayspark.functions.geo import planar_m
from wayspark.operators import quadtree

#: Other sites that a cell is first cut by.
START = 8
#: What counts as no distance, as a share of the envelope's larger side.
TOLERANCE = 1e-12
_DIST = lambda y1, x1, y2, x2: planar_m(x1, y1, x2, y2)
_OTHER = ("other", "ox", "oy")
_SIDE = pa.struct([("x", pa.float64()), ("y", pa.float64()), ("other", pa.int64())])
SIDES = "array<struct<x: double, y: double, other: bigint>>"


def cut(ring: list[tuple], dx: float, dy: float, other: int) -> list[tuple]:
    """A ring of (x, y, neighbour along the side that begins there) about the origin, cut half way to (dx, dy)."""
    half = (dx * dx + dy * dy) / 2
    beyond = [x * dx + y * dy - half for x, y, _ in ring]
    if max(beyond, default=0.0) <= 0:
        return ring
    out = []
    for i, (x, y, along) in enumerate(ring):
        j = (i + 1) % len(ring)
        if beyond[i] <= 0:
            out.append((x, y, along))
        if (beyond[i] <= 0) != (beyond[j] <= 0):
            part = beyond[i] / (beyond[i] - beyond[j])
            at = (x + part * (ring[j][0] - x), y + part * (ring[j][1] - y))
            out.append((*at, other if beyond[i] <= 0 else along))
    return out


def _clipped(due: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """``sides`` of each site's cell, relative to the site, and its area, from the sites in ``near``."""
    x0, y0, x1, y1 = box

    def run(batches):
        for batch in batches:
            sides, areas = [], []
            for x, y, near in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "near")), strict=True):
                ring = [(x0 - x, y0 - y, None), (x1 - x, y0 - y, None), (x1 - x, y1 - y, None), (x0 - x, y1 - y, None)]
                for _, dx, dy, other in sorted((math.hypot(n["ox"] - x, n["oy"] - y), n["ox"] - x, n["oy"] - y, n["other"]) for n in near):
                    ring = cut(ring, dx, dy, other)
                turned = zip(ring, ring[1:] + ring[:1], strict=True)
                areas.append(sum(a[0] * b[1] - b[0] * a[1] for a, b in turned) / 2)
                sides.append([dict(zip(("x", "y", "other"), corner, strict=True)) for corner in ring])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sides, pa.list_(_SIDE)), pa.array(areas, pa.float64())], names=[*batch.schema.names, "sides", "area"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in due.schema)
    return due.mapInArrow(run, f"{kind}, sides {SIDES}, area double")


def cells(sites: DataFrame) -> DataFrame:
    """site_id, x, y, area and ``sides``: corners counter-clockwise, each with the site beyond the side from it to the next.

    ``other`` is null along the envelope. No sites give no cells.
    """
    finite = lambda c: F.col(c).isNotNull() & (F.abs(F.col(c)) < float("inf"))
    own = durable(sites.where(finite("x") & finite("y")).groupBy("x", "y").agg(F.min("site_id").cast("long").alias("site_id")).select("site_id", F.col("x").cast("double"), F.col("y").cast("double")), "sites")
    to = own.select(F.col("site_id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    tree = quadtree.build(to, "ox", "oy", list(_OTHER))
    if tree is None:
        return own.select("*", F.lit(0.0).alias("area"), F.lit(None).cast(SIDES).alias("sides"))
    x0, y0, x1, y1 = own.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    margin = max(x1 - x0, y1 - y0) or 1.0
    near_0 = TOLERANCE * 3 * margin
    near = quadtree.knn(own, tree, ["site_id"], ("y", "x"), ("oy", "ox"), list(_OTHER), _DIST, START + 1).where("site_id <> other")
    near = near.groupBy("site_id").agg(F.collect_list(F.struct(*_OTHER)).alias("near"))
    none = F.array().cast("array<struct<other: bigint, ox: double, oy: double>>")
    due = own.join(near, "site_id", "left").select("site_id", "x", "y", F.coalesce("near", none).alias("near"))
    done = None
    while True:
        shaped = durable(_clipped(due, (x0 - margin, y0 - margin, x1 + margin, y1 + margin)), "cells")
        corner = shaped.select("site_id", "x", "y", F.col("near.other").alias("known"), F.posexplode("sides").alias("pos", "c"))
        corner = corner.select("site_id", "known", "pos", (F.col("x") + F.col("c.x")).alias("cx"), (F.col("y") + F.col("c.y")).alias("cy"), F.hypot("c.x", "c.y").alias("radius"))
        found = quadtree.knn(corner.select("site_id", "pos", "cx", "cy"), tree, ["site_id", "pos"], ("cy", "cx"), ("oy", "ox"), list(_OTHER), _DIST)
        nearer = corner.join(found, ["site_id", "pos"]).where((F.col("dist_m") < F.col("radius") - near_0) & (F.col("other") != F.col("site_id")) & ~F.array_contains("known", F.col("other")))
        new = durable(nearer.groupBy("site_id").agg(F.collect_set(F.struct(*_OTHER)).alias("new")), "nearer")
        right = shaped.join(new, "site_id", "left_anti").select("site_id", "x", "y", "area", "sides")
        done = right if done is None else done.unionByName(right)
        if new.isEmpty():
            break
        due = shaped.join(new, "site_id").select("site_id", "x", "y", F.concat("near", "new").alias("near"))
    out = durable(done, "voronoi")
    for table in (own, tree.nodes, tree.places):
        release(table)
    return out


def sides_of(shapes: DataFrame) -> DataFrame:
    """One row for each side: site_id, x0, y0, x1, y1, other and length; those shorter than the last digits of places are left out."""
    after = F.element_at("sides", (F.col("pos") + 1) % F.size("sides") + 1)
    rows = shapes.select("*", F.posexplode("sides").alias("pos", "a")).withColumn("b", after)
    ends = [(F.col(c) + F.col(f"{p}.{c}")).alias(f"{c}{k}") for k, p in enumerate("ab") for c in "xy"]
    length = F.hypot(F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y"))
    return rows.select("site_id", *ends, F.col("a.other").alias("other"), length.alias("length")).where(F.col("length") > 1e-6)


def delaunay_edges(shapes: DataFrame) -> DataFrame:
    """source < target and length: pairs of sites whose cells have a side in common."""
    pairs = sides_of(shapes).where("other is not null").select(F.least("site_id", "other").alias("source"), F.greatest("site_id", "other").alias("target")).distinct()
    end = lambda c, k: shapes.select(F.col("site_id").alias(c), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
    placed = pairs.join(end("source", 0), "source").join(end("target", 1), "target")
    return placed.select("source", "target", planar_m(*map(F.col, ("x0", "y0", "x1", "y1"))).alias("length"))


def boundaries(shapes: DataFrame, clusters: DataFrame) -> DataFrame:
    """Sides of merged cells, the cluster on their left: cluster_id, x0, y0, x1, y1, length and the cluster beyond (null: envelope).

    ``clusters`` has site_id and cluster_id. Sides between two sites of a cluster cancel out.
    """
    own = clusters.select("site_id", "cluster_id")
    beyond = clusters.select(F.col("site_id").alias("other"), F.col("cluster_id").alias("beyond"))
    both = sides_of(shapes).join(own, "site_id").join(beyond, "other", "left")
    return both.where(~F.col("cluster_id").eqNullSafe(F.col("beyond"))).select("cluster_id", "x0", "y0", "x1", "y1", "length", "beyond")


def merged_cells(shapes: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster_id, n_cells, area and boundary (the length of all its rings)."""
    areas = shapes.join(clusters.select("site_id", "cluster_id"), "site_id").groupBy("cluster_id").agg(F.count("*").alias("n_cells"), F.sum("area").alias("area"))
    around = boundaries(shapes, clusters).groupBy("cluster_id").agg(F.sum("length").alias("boundary"))
    return areas.join(around, "cluster_id", "left")


def as_wkt(shapes: DataFrame) -> DataFrame:
    """site_id and the closed ring of its cell as a WKT polygon."""
    number = lambda c: c.cast("string")
    point: Column = F.transform("sides", lambda s: F.concat_ws(" ", number(F.col("x") + s["x"]), number(F.col("y") + s["y"])))
    ring = F.concat(point, F.slice(point, 1, 1))
    return shapes.select("site_id", F.concat(F.lit("POLYGON (("), F.array_join(ring, ", "), F.lit("))")).alias("wkt"))
