"""Protection cells around sensitive places, and trajectories cut where they lead to one.

Planar: sites have site_id, x, y; trajectories have traj_id, pos (from 1), ts, x, y. A cell
is the set of places nearest to the sites of one cluster, so it is never drawn as a polygon.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from wayspark.functions.durable import durable
from wayspark.functions.geo import direction_deg, planar_m
from wayspark.operators.components import components
from wayspark.operators import quadtree
from wayspark.operators.joins import nearest, within_radius
from wayspark.operators.stops import _hull

#: Places of a leaf, and wedges counted at a time, where sites in wedges are counted by arrays.
WEDGE_LEAF, WEDGES = 4096, 1 << 16
_DIST = lambda y1, x1, y2, x2: planar_m(x1, y1, x2, y2)


def cluster_nodes(centroids: DataFrame) -> DataFrame:
    """site_id, x, y: sites numbered from 0 in the given order (column ``n``); of equal places the first stays."""
    ids = centroids.select((F.col("n") - 1).alias("site_id"), "x", "y")
    return ids.groupBy("x", "y").agg(F.min("site_id").alias("site_id")).select("site_id", "x", "y")


def neighbour_edges(sites: DataFrame, k: int) -> DataFrame:
    """source < target and length: every site's ``k`` nearest sites, each edge once.

    A cluster of fewer than k sites has its shortest way out among them, so greedy
    clustering needs no other edges. The sites go down their own quadtree.
    """
    to = sites.select(F.col("site_id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    tree = quadtree.build(to, "ox", "oy", ["other"])
    if tree is None:
        return sites.select(F.col("site_id").alias("source"), F.col("site_id").alias("target"), F.lit(0.0).alias("length")).limit(0)
    # a site is one of the k + 1 nearest to itself, or has as many at its own place
    near = quadtree.knn(sites, tree, ["site_id"], ("y", "x"), ("oy", "ox"), ["other"], _DIST, k + 1).where("site_id <> other")
    order = W.partitionBy("site_id").orderBy("dist_m", "other")
    out = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select(F.least("site_id", "other").alias("source"), F.greatest("site_id", "other").alias("target"), F.col("dist_m").alias("length")).distinct()


def greedy_clusters(sites: DataFrame, k: int = 4) -> tuple[DataFrame, DataFrame]:
    """site_id, x, y, cluster_id; and the edges (source, target, length) that merged clusters.

    Edges are taken by length, source and target; one merges two clusters if either has
    fewer than ``k`` sites, the smaller into the larger, of equal ones the target's into the
    source's. That is done in rounds, until nothing is due. The shortest edge out of a small
    cluster is due if it is the other cluster's too, or leads, by shortest edges out of small
    clusters, to one of k sites: no edge that is shorter leaves any of these. So a row of
    sites with ever shorter gaps takes a few rounds, not one for each site.
    """
    edges = durable(neighbour_edges(sites, k), "edges")
    own = durable(sites.select("site_id", F.col("site_id").alias("cluster_id")), "clusters")
    used = None
    while True:
        size = own.groupBy("cluster_id").agg(F.count("*").alias("n"))
        at = own.join(size, "cluster_id")
        side = lambda s, c, at=at: at.select(F.col("site_id").alias(s), F.col("cluster_id").alias(f"c{c}"), F.col("n").alias(f"n{c}"))
        out = durable(edges.join(side("source", 1), "source").join(side("target", 2), "target").where("c1 <> c2"), "between")
        way = lambda a, b: out.where(F.col(f"n{a}") < k).select(F.col(f"c{a}").alias("c"), F.struct("length", "source", "target", F.col(f"c{b}").alias("to"), F.col(f"n{a}").alias("n"), F.col(f"n{b}").alias("to_n")).alias("e"))  # noqa: E731, B023
        best = durable(way(1, 2).unionByName(way(2, 1)).groupBy("c").agg(F.min("e").alias("e")).select("c", "e.*"), "best")
        if best.isEmpty():
            break
        other = best.select(F.col("c").alias("to"), "source", "target", F.col("n").alias("other_n"))
        sides = out.select("source", "target", "c1", "c2")
        mutual = best.join(other, ["to", "source", "target"]).join(sides, ["source", "target"])
        into_first = F.col("n") >= F.col("other_n")
        pairs = mutual.where("c = c1").select(F.when(into_first, F.col("c2")).otherwise(F.col("c1")).alias("old"), F.when(into_first, F.col("c1")).otherwise(F.col("c2")).alias("new"), "source", "target", "length")
        direct = best.where(F.col("to_n") >= k).select(F.col("c").alias("old"), F.col("to").alias("new"), "source", "target", "length")
        due = durable(direct.unionByName(pairs), "due")
        if 4 * due.count() < best.count():  # long rows of small clusters: follow them to their ends
            roots = components(best.select(F.col("c").alias("u"), F.col("to").alias("v")))
            big = best.where(F.col("to_n") >= k).join(roots, F.col("to") == F.col("node")).groupBy("root").agg(F.min("to").alias("new"))
            whole = best.join(roots, F.col("c") == F.col("node")).join(big, "root").select(F.col("c").alias("old"), "new", "source", "target", "length")
            due = durable(whole.unionByName(pairs), "due")
        own = durable(own.join(due.select("old", "new"), F.col("cluster_id") == F.col("old"), "left").select("site_id", F.coalesce("new", "cluster_id").alias("cluster_id")), "clusters")
        took = due.select("source", "target", "length")
        used = took if used is None else used.unionByName(took)
    return sites.join(own, "site_id"), used if used is not None else edges.limit(0)


def cluster_stats(clusters: DataFrame, merges: DataFrame) -> DataFrame:
    """One row: clusters, sites, mean sites of a cluster, length of all merges."""
    a = clusters.agg(F.count_distinct("cluster_id").alias("n_clusters"), F.count("*").alias("n_sites"))
    b = merges.agg(F.coalesce(F.sum("length"), F.lit(0.0)).alias("merge_length"))
    one = F.lit(1)
    return a.withColumn("_", one).join(b.withColumn("_", one), "_").select("n_clusters", "n_sites", F.try_divide("n_sites", "n_clusters").alias("mean_sites"), "merge_length")


def cluster_hulls(clusters: DataFrame) -> DataFrame:
    """cluster_id, pos, x, y of the convex hull's corners, and its perimeter; small clusters give a line or a point."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        hull = _hull(list(zip(df["x"], df["y"], strict=True)))
        ring = [*hull, hull[0]]
        length = sum(((b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2) ** 0.5 for a, b in zip(ring, ring[1:]))
        return pd.DataFrame({"cluster_id": df["cluster_id"].iloc[0], "pos": range(len(hull)), "x": [p[0] for p in hull], "y": [p[1] for p in hull], "perimeter": length})

    return clusters.select("cluster_id", "x", "y").groupBy("cluster_id").applyInPandas(run, "cluster_id long, pos long, x double, y double, perimeter double")


def cell_of_point(points: DataFrame, sites: DataFrame, pid: str) -> DataFrame:
    """Adds ``cell``, the cluster of the nearest site, and ``dist``; ties go to the smaller site_id.

    A point with a null coordinate has a null cell.
    """
    named = sites.select(F.col("site_id").alias("near_site"), F.col("cluster_id").alias("cell"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    return nearest(points, named, ("y", "x"), ("sy", "sx"), pid, ["near_site", "cell"], _DIST)


def endpoints(traj: DataFrame) -> DataFrame:
    """traj_id and the first and last point's pos, ts, x, y."""
    at = F.struct("pos", "ts", "x", "y")
    return traj.groupBy("traj_id").agg(F.min_by(at, "pos").alias("a"), F.max_by(at, "pos").alias("b")).select(
        "traj_id", *(F.col(f"{s}.{c}").alias(f"{n}_{c}") for s, n in (("a", "first"), ("b", "last")) for c in ("pos", "ts", "x", "y"))
    )


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point is inside a ring (array of structs x, y, not closed), by ray casting."""
    n = F.size(ring)

    def crossing(i: Column) -> Column:
        a, b = F.element_at(ring, i + 1), F.element_at(ring, (i + 1) % n + 1)
        over = (a["y"] > y) != (b["y"] > y)
        return over & (x < a["x"] + F.try_divide((b["x"] - a["x"]) * (y - a["y"]), b["y"] - a["y"]))

    return F.size(F.filter(F.sequence(F.lit(0), n - 1), crossing)) % 2 == 1


def split_at_stays(traj: DataFrame, stays: DataFrame) -> DataFrame:
    """Pieces (``piece`` from 0) between stays (traj_id, start_ts, end_ts); points strictly inside a stay go.

    A stay's first point ends a piece, its last one begins the next; pieces of one point go.
    """
    mark = lambda df, ts, order, delta, end: df.select("traj_id", F.col(ts).alias("ts"), F.lit(order).alias("o"), F.lit(delta).alias("d"), F.lit(end).alias("e"))
    rows = traj.withColumns({"o": F.lit(1), "d": F.lit(0), "e": F.lit(0)}).unionByName(mark(stays, "end_ts", 0, -1, 1), allowMissingColumns=True).unionByName(mark(stays, "start_ts", 2, 1, 0), allowMissingColumns=True)
    w = W.partitionBy("traj_id").orderBy("ts", "o", "pos").rowsBetween(W.unboundedPreceding, 0)
    kept = rows.withColumns({"depth": F.sum("d").over(w), "piece": F.sum("e").over(w)}).where("o = 1 and depth <= 0").select(*traj.columns, "piece")
    return kept.withColumn("_n", F.count("*").over(W.partitionBy("traj_id", "piece"))).where("_n > 1").drop("_n")


def in_wedge(x: Column, y: Column, direction: Column, px: Column, py: Column, alpha: float) -> Column:
    """Whether (px, py) lies within alpha/2 degrees of ``direction`` as seen from (x, y)."""
    apart = F.abs(direction_deg(x, y, px, py) - direction)
    return (apart <= alpha / 2) | (360 - apart <= alpha / 2)


def end_cells(celled: DataFrame) -> DataFrame:
    """traj_id, side (start, end) and the cell of that end's point."""
    ends = celled.groupBy("traj_id").agg(F.min_by("cell", "pos").alias("start"), F.max_by("cell", "pos").alias("end"))
    return ends.select("traj_id", F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(s).alias("cell")) for s in ("start", "end")))).alias("e")).select("traj_id", "e.*")


def wedge_sides(direction: Column, alpha: float) -> dict[str, Column]:
    """The half planes ax + by <= 0, as seen from the apex, that a wedge below 180 degrees is shared by."""
    t, ux, uy = math.tan(math.radians(alpha / 2)), F.cos(F.radians(direction)), F.sin(F.radians(direction))
    return {"_a0": -uy - t * ux, "_b0": ux - t * uy, "_a1": uy - t * ux, "_b1": -ux - t * uy}


def box_in_wedge() -> tuple[Column, Column]:
    """Whether a node's box is inside the wedge for sure, and whether it is outside: a linear form is least and greatest at corners."""
    x0, x1, y0, y1 = (F.col(f"_{n}{k}") - F.col(c) for k, c in ((0, "x"), (1, "y")) for n in ("lo", "hi"))
    slack = 1e-6 * (1 + F.greatest(*map(F.abs, (x0, x1, y0, y1))))
    sides = [(F.col(f"_a{k}"), F.col(f"_b{k}")) for k in (0, 1)]
    most = [F.greatest(a * x0, a * x1) + F.greatest(b * y0, b * y1) for a, b in sides]
    least = [F.least(a * x0, a * x1) + F.least(b * y0, b * y1) for a, b in sides]
    return (most[0] < -slack) & (most[1] < -slack), (least[0] > slack) | (least[1] > slack)


def count_in_wedges(x: np.ndarray, y: np.ndarray, direction: np.ndarray, sx: np.ndarray, sy: np.ndarray, alpha: float) -> np.ndarray:
    """How many of the sites lie in each wedge: by half planes, and by their direction where that is within rounding."""

    def exact(k: np.ndarray) -> np.ndarray:
        seen = np.degrees(np.arctan2(sy[None, :] - y[k, None], sx[None, :] - x[k, None]))
        apart = np.abs(np.where(seen < 0, seen + 360, seen) - direction[k, None])
        return np.count_nonzero((apart <= alpha / 2) | (360 - apart <= alpha / 2), axis=1)

    blocks = range(0, len(x), 64)  # what a block makes stays in the processor's cache
    if alpha >= 180:
        return np.concatenate([exact(np.arange(k, min(k + 64, len(x)))) for k in blocks])
    t, ux, uy = math.tan(math.radians(alpha / 2)), np.cos(np.radians(direction)), np.sin(np.radians(direction))
    cx, cy = (sx.min() + sx.max()) / 2, (sy.min() + sy.max()) / 2
    px, py = x - cx, y - cy
    sites = np.stack([sx - cx, sy - cy, np.ones(len(sx))]).astype("float32")
    sides = [np.stack([a, b, -(a * px + b * py)], axis=1).astype("float32") for a, b in ((-uy - t * ux, ux - t * uy), (uy - t * ux, -ux - t * uy))]
    # a form is the sum of three products of 24 bits; it is that much of the largest of them off at most
    wide = max(np.abs(sites).max(), 1.0) + np.hypot(px, py)
    slack = ((2 + 2 * t) * wide * 1e-6).astype("float32")
    out = np.empty(len(x), "int64")
    for k in blocks:
        part = slice(k, k + 64)
        form = np.maximum(sides[0][part] @ sites, sides[1][part] @ sites)
        sure, possible = (np.count_nonzero(form <= sign * slack[part, None], axis=1) for sign in (-1, 1))
        out[part] = sure
        open_ = np.flatnonzero(sure != possible)
        for i in open_:
            at = np.flatnonzero(np.abs(form[i]) <= slack[k + i])
            seen = np.degrees(np.arctan2(sy[at] - y[k + i], sx[at] - x[k + i]))
            apart = np.abs(np.where(seen < 0, seen + 360, seen) - direction[k + i])
            out[k + i] += np.count_nonzero(((apart <= alpha / 2) | (360 - apart <= alpha / 2)) & (form[i][at] > -slack[k + i]))
    return out


def sites_in_wedges(apexes: DataFrame, sites: DataFrame, key: list[str], alpha: float, leaf: int = WEDGE_LEAF) -> DataFrame:
    """key, n_in: how many sites of ``cell`` each wedge (x, y, direction) holds; none give no row.

    ``apexes`` has a row for each of its cells. A wedge goes down the quadtree of the cell's
    sites only at nodes that its sides cut; nodes inside count as a whole. The places of a
    leaf, ``leaf`` at most, are counted by arrays, a part of the leaf's wedges at a time. So a
    wedge meets few rows, and a cluster of any size is never joined with all points.
    """
    named = sites.select(F.col("cluster_id").alias("cell"), F.col("x").alias("_sx"), F.col("y").alias("_sy"))
    tree = quadtree.build(named, "_sx", "_sy", [], ["cell"], leaf=leaf)
    if tree is None:
        return apexes.select(*key, F.lit(0).cast("long").alias("n_in")).limit(0)
    narrow = alpha < 180  # wider wedges are left to the single sites
    forms = wedge_sides(F.col("_direction"), alpha) if narrow else {}
    own = [*key, "x", "y", "_direction"]
    keep = [*own, *forms]

    def decide(rows: DataFrame) -> DataFrame:
        inside, outside = box_in_wedge() if narrow else (F.lit(False), F.lit(False))
        rows = rows.withColumns({"_inside": inside, "_outside": outside}).where("not _outside").drop("_outside")
        return rows.withColumn("_go", ~F.col("_inside") & ~F.col("_leaf"))

    left = quadtree.descend(apexes.where("_direction is not null").select("*", *(c.alias(n) for n, c in forms.items())).select("cell", *keep), tree, key, keep, decide)
    left = durable(left.select(*own, "cell", "_level", "_cell", "_inside", "_sites"), "wedges")
    whole = left.where("_inside").select(*key, F.col("_sites").alias("n_in"))
    place = ["cell", "_level", "_cell"]
    cut = left.where("not _inside")
    parts = cut.groupBy(*place).agg(F.ceil(F.count("*") / WEDGES).cast("int").alias("_parts"))
    dealt = cut.join(parts, place).withColumn("_part", F.pmod(F.xxhash64(*key), F.col("_parts")).cast("int")).select(*place, "_part", *own)
    copied = tree.places.join(parts, place).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).select(*place, "_part", "_sx", "_sy")

    def run(wedges: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        out = wedges[key].copy()
        if len(wedges):
            out["n_in"] = count_in_wedges(*(wedges[c].to_numpy("float64") for c in ("x", "y", "_direction")), at["_sx"].to_numpy(), at["_sy"].to_numpy(), alpha)
            out = out[out["n_in"] > 0]
        else:
            out["n_in"] = pd.Series(dtype="int64")
        return out

    schema = T.StructType([*(left.schema[c] for c in key), T.StructField("n_in", T.LongType())])
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes but much work, so their size must not set the number of tasks
    both = [df.repartition(n, *place, "_part").groupBy(*place, "_part") for df in (dealt, copied)]
    counted = both[0].cogroup(both[1]).applyInPandas(run, schema)
    found = whole.unionByName(counted)
    return found.groupBy(*key).agg(F.sum("n_in").alias("n_in")) if tree.depth else found


def wedges(celled: DataFrame, sites: DataFrame, alpha: float = 60.0, cells: DataFrame | None = None) -> DataFrame:
    """Points beside the wedge counts towards and from the sensitive cells of their ends.

    For the start, the direction is that from the next point to this one; for the end, from
    the point before. ``start_in`` of ``start_n`` sites of the start's cells lie in that
    wedge, likewise ``end_in`` of ``end_n``; a point without that neighbour has null counts.
    The cells are those of the end points, or all in ``cells`` (traj_id, side, cell) together.
    """
    w = W.partitionBy("traj_id").orderBy("pos")
    towards = lambda f: direction_deg(f("x").over(w), f("y").over(w), F.col("x"), F.col("y"))
    rows = durable(celled.withColumns({"_start": towards(F.lead), "_end": towards(F.lag)}).withColumn("_row", F.monotonically_increasing_id()), "directed")
    cells = durable((end_cells(celled) if cells is None else cells).distinct(), "end-cells")
    size = sites.groupBy(F.col("cluster_id").alias("cell")).agg(F.count("*").alias("_n"))
    total = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("_n"))), F.lit(0)).cast("int").alias(f"{s}_n")
    totals = cells.join(size, "cell").groupBy("traj_id").agg(total("start"), total("end"))
    direction = F.when(F.col("side") == "start", F.col("_start")).otherwise(F.col("_end"))
    apexes = rows.select("traj_id", "_row", "x", "y", "_start", "_end").join(cells, "traj_id").withColumn("_direction", direction)
    found = sites_in_wedges(apexes, sites, ["_row", "side"], alpha)
    counted = found.groupBy("_row").agg(*(F.sum(F.when(F.col("side") == s, F.col("n_in"))).cast("int").alias(f"{s}_in") for s in ("start", "end")))
    out = rows.join(counted, "_row", "left").join(totals, "traj_id", "left")
    for s in ("start", "end"):
        out = out.withColumns({f"{s}_in": F.when(F.col(f"_{s}").isNotNull(), F.coalesce(f"{s}_in", F.lit(0))), f"{s}_n": F.coalesce(f"{s}_n", F.lit(0))})
    return out.drop("_start", "_end", "_row")


def directions(wedged: DataFrame) -> DataFrame:
    """Adds the direction condition (all or none of the sites) for either end."""
    clear = lambda s: F.coalesce((F.col(f"{s}_in") == 0) | (F.col(f"{s}_in") == F.col(f"{s}_n")), F.lit(False))
    return wedged.withColumns({f"{s}_clear": clear(s) for s in ("start", "end")})


def proximity(celled: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Adds the proximity condition for either end: the point is in none of that end's cells."""
    cells = (end_cells(celled) if cells is None else cells).distinct()
    near = cells.groupBy("traj_id", "cell").agg(*(F.bool_or(F.col("side") == s).alias(f"_{s}") for s in ("start", "end")))
    out = celled.join(near, ["traj_id", "cell"], "left")
    return out.select(*celled.columns, *((~F.coalesce(f"_{s}", F.lit(False))).alias(f"{s}_far") for s in ("start", "end")))


def conditions(celled: DataFrame, sites: DataFrame, alpha: float = 60.0, cells: DataFrame | None = None) -> DataFrame:
    """Points with both conditions, and whether each may be the cut at either end."""
    out = directions(wedges(proximity(celled, cells), sites, alpha, cells))
    return out.withColumns({f"{s}_ok": F.col(f"{s}_far") & F.col(f"{s}_clear") for s in ("start", "end")})


def truncate(celled: DataFrame, sites: DataFrame, alpha: float = 60.0, cells: DataFrame | None = None) -> DataFrame:
    """Trajectories from their first to their last admissible point; those without both go."""
    rows = conditions(celled, sites, alpha, cells)
    cut = rows.groupBy("traj_id").agg(F.min(F.when(F.col("start_ok"), F.col("pos"))).alias("first_keep"), F.max(F.when(F.col("end_ok"), F.col("pos"))).alias("last_keep")).where("first_keep < last_keep")
    return celled.join(cut, "traj_id").where("pos between first_keep and last_keep").drop("first_keep", "last_keep")


def truncate_at_stays(celled: DataFrame, stays: DataFrame, sites: DataFrame, alpha: float = 60.0, buffer: float = 0.0) -> DataFrame:
    """Trajectories split at ``stays`` (traj_id, start_ts, end_ts), each piece cut at both ends, put together again.

    The ends of pieces are the places of stays and the trajectory's own ends, all sensitive.
    With a ``buffer``, all cells within that distance of an end are. ``piece`` counts from 0,
    ``pos`` from 1 in each piece.
    """
    pieces = split_at_stays(celled, stays)
    own = W.partitionBy("traj_id", "piece").orderBy("pos")
    key = F.to_json(F.struct("traj_id", "piece"))
    pieces = durable(pieces.withColumns({"_traj": F.col("traj_id"), "pos": F.row_number().over(own).cast("long"), "traj_id": key}), "pieces")
    cells = None
    if buffer > 0:
        ends = pieces.groupBy("traj_id").agg(F.min_by(F.struct("x", "y"), "pos").alias("start"), F.max_by(F.struct("x", "y"), "pos").alias("end"))
        both = ends.select("traj_id", F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"{s}.x").alias("x"), F.col(f"{s}.y").alias("y")) for s in ("start", "end")))).alias("e")).select("traj_id", "e.*")
        cells = cells_within(both.withColumn("_id", F.concat_ws("/", "traj_id", "side")), sites, "_id", buffer).select("traj_id", "side", "cell")
    return truncate(pieces, sites, alpha, cells).withColumn("traj_id", F.col("_traj")).drop("_traj")


def _cut(corners: list[tuple[float, float]], u: float, v: float, w: float) -> list[tuple[float, float]]:
    """A convex polygon's part in the half plane ux + vy <= w."""
    out = []
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1]):
        a, b = u * ax + v * ay - w, u * bx + v * by - w
        if a <= 0:
            out.append((ax, ay))
        if (a < 0 < b) or (b < 0 < a):
            t = a / (a - b)
            out.append((ax + t * (bx - ax), ay + t * (by - ay)))
    return out


def _off(corners: list[tuple[float, float]]) -> float:
    """Distance of a convex polygon's boundary from the origin."""
    best = math.inf
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1]):
        dx, dy = bx - ax, by - ay
        size = dx * dx + dy * dy
        t = min(1.0, max(0.0, -(ax * dx + ay * dy) / size)) if size else 0.0
        best = min(best, math.hypot(ax + t * dx, ay + t * dy))
    return best


def reached(dx: np.ndarray, dy: np.ndarray, kind: np.ndarray, radius: float, few: int = 64) -> set:
    """Of which ``kind`` there is a site (dx, dy from the centre) whose cell meets the circle.

    A cell lies in the half planes towards its site. One of these beyond the circle rules it
    out. The nearest place of all of them is the centre, or the foot on the nearest line if
    that is in the cell; only cells whose nearest place is a corner are cut. What a site
    misses of the circle is nearer to others that reach it, so those ruled out by the ``few``
    nearest sites need not be looked at again.
    """
    slack = 1e-9 * max(radius, 1.0)

    def planes(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        u, v = dx[j] - dx[i, None], dy[j] - dy[i, None]
        size, far = np.hypot(u, v), dx * dx + dy * dy
        other = size > 0
        size = np.where(other, size, 1.0)
        return u / size, v / size, np.where(other, (far[j] - far[i, None]) / 2 / size, np.inf)

    near = np.argsort(dx * dx + dy * dy)[:few]
    left = np.concatenate([k[planes(k, near)[2].min(axis=1) >= -radius - slack] for k in np.array_split(np.arange(len(dx)), 1 + len(dx) // 4096)])
    hit = set()
    for i in np.array_split(left, 1 + len(left) ** 2 // (1 << 20)):
        if not len(i):
            continue
        u, v, w = planes(i, left)
        row, k = np.arange(len(i)), w.argmin(axis=1)
        least = w[row, k]
        inner = least >= -slack
        foot = np.where(inner | np.isinf(least), 0.0, least)
        qx, qy = foot * u[row, k], foot * v[row, k]
        sure = inner | ((least >= -radius - slack) & (u * qx[:, None] + v * qy[:, None] <= w + slack).all(axis=1))
        hit.update(kind[i[sure]])
        for n in np.flatnonzero(~sure & (least >= -radius - slack)):
            if kind[i[n]] in hit:
                continue
            wide = radius + slack
            corners = [(-wide, -wide), (wide, -wide), (wide, wide), (-wide, wide)]
            for m in np.argsort(w[n]):
                if w[n, m] > 1.5 * wide:
                    break
                corners = _cut(corners, float(u[n, m]), float(v[n, m]), float(w[n, m]) + slack)
                if not corners or _off(corners) > wide:
                    corners = []
                    break
            if corners:
                hit.add(kind[i[n]])
    return hit


def cells_within(points: DataFrame, sites: DataFrame, pid: str, buffer: float) -> DataFrame:
    """Each point (unique ``pid``) with every ``cell`` that has a place within ``buffer``.

    Only sites up to twice the buffer farther than the nearest can own such a place, and
    only these bound each other there. A place is looked up once, however many points it has.
    """
    places = durable(points.select("x", "y").where("x is not null and y is not null").distinct().withColumn("_pid", F.monotonically_increasing_id()), "at")
    near = durable(cell_of_point(places, sites, "_pid").where("cell is not null"), "nearest")
    shifted = near.withColumn("_ring", F.ceil(F.log2(F.greatest(F.col("dist") + 2 * buffer, F.lit(1e-6)))).cast("int"))
    found = None
    named = sites.select(F.col("cluster_id").alias("_cluster"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    for ring in [r[0] for r in shifted.select("_ring").distinct().orderBy("_ring").collect()]:  # one for each power of 2 of metres
        own = shifted.where(F.col("_ring") == ring).select("_pid", "x", "y", F.col("dist").alias("_far"))
        rows = within_radius(own, named, 2.0**ring, _DIST, None, ("y", "x"), ("sy", "sx"), planar=True).where(F.col("dist_m") <= F.col("_far") + 2 * buffer).select("_pid", "x", "y", "_cluster", "sx", "sy")
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return points.withColumn("cell", F.lit(None).cast(sites.schema["cluster_id"].dataType)).limit(0)
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes but much work, so their size must not set the number of tasks
    at = F.collect_list(F.struct((F.col("sx") - F.col("x")).alias("dx"), (F.col("sy") - F.col("y")).alias("dy"), "_cluster"))
    each = found.repartition(n, "_pid").groupBy("_pid", "x", "y").agg(at.alias("_at")).select("x", "y", *(F.col(f"_at.{c}").alias(c) for c in ("dx", "dy", "_cluster")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            out = []
            for x, y, dx, dy, kind in df.itertuples(index=False):
                out += [(x, y, c) for c in reached(np.asarray(dx), np.asarray(dy), np.asarray(kind, dtype=object), buffer)]
            yield pd.DataFrame(out, columns=["x", "y", "cell"])

    cells = each.mapInPandas(run, T.StructType([each.schema["x"], each.schema["y"], T.StructField("cell", sites.schema["cluster_id"].dataType)]))
    return points.join(cells, ["x", "y"]).select(*points.columns, "cell")


def wedge_triangles(traj: DataFrame, radius: float = 100.0, half_angle: float = 30.0, side: str = "start") -> DataFrame:
    """Corners of the wedge at each point towards an end: the point and two at ``radius``.

    ``is_final`` marks the point next to that end, the last one to be looked at from there.
    """
    w = W.partitionBy("traj_id").orderBy("pos")
    shift, last = (F.lead, F.lag) if side == "start" else (F.lag, F.lead)
    d = direction_deg(shift("x").over(w), shift("y").over(w), F.col("x"), F.col("y"))
    corner = lambda sign, f: f(F.radians(F.col("direction") + sign * half_angle)) * radius
    return traj.withColumns({"direction": d, "is_final": last("pos").over(w).isNull()}).where("direction is not null").select(
        "traj_id", "pos", "x", "y", "direction", (F.col("x") + corner(-1, F.cos)).alias("x1"), (F.col("y") + corner(-1, F.sin)).alias("y1"),
        (F.col("x") + corner(1, F.cos)).alias("x2"), (F.col("y") + corner(1, F.sin)).alias("y2"), "is_final",
    )


def overlaps(boxes: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Boxes (min_x, min_y, max_x, max_y) that meet the envelope, edges included."""
    return boxes.where((F.col("min_x") <= x1) & (F.col("max_x") >= x0) & (F.col("min_y") <= y1) & (F.col("max_y") >= y0))
