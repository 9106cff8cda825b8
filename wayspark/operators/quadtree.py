"""Quadtrees over sites as tables, for searches that follow the data's own density.

A tree is two tables. ``nodes`` has a row for each cell that holds sites, keyed by its
parent (and another keyed by itself, for queries that are done there): how many there are,
and the box around them; a cell of more than LEAF places is
parted into 16 (two levels), so cells are as fine as the sites are dense there. ``places``
has the sites, each with its leaf. Sites of one place count as one. A search is a chain of
equi-joins on (``by``, level, cell): every query begins at the root and goes on from each
node left to its children.
What is left is decided by bounds on the node's box, so a query meets a few nodes a level
wherever it lies, and no join holds all sites of a dense spot against each other.

``by`` gives a tree for each of its values (a participant, a cluster). Coordinates of sites
are planar, or, with ``sphere``, degrees, kept as points of the unit sphere.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wayspark.functions.durable import durable, release
from wayspark.functions.geo import EARTH_RADIUS_M

#: Places in a leaf; levels that a search goes down at a time; bits of a key on each axis.
LEAF, STEP, BITS = 16, 2, 30
#: Levels of nodes that are counted in one pass over the sites.
PASS = 4
#: Distances of two engines differ by less.
ROUNDING_M = 1e-6
#: An ellipsoid's distances differ from a sphere's by less than this.
ELLIPSOID = 0.01


@dataclass
class Tree:
    nodes: DataFrame
    places: DataFrame
    by: list[str]
    axes: int
    depth: int  # levels of the deepest leaf


def _spread(v: Column) -> Column:
    """The bits of a number below 2**31, each followed by a 0."""
    v = v.cast("long")
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def axes_of(x: Column, y: Column, sphere: bool) -> list[Column]:
    """Coordinates in which boxes bound distances: the plane's, or those of the unit sphere (x is the longitude)."""
    if not sphere:
        return [x, y]
    lon, lat = F.radians(x), F.radians(y)
    return [F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)]


def build(sites: DataFrame, x: str, y: str, pick: list[str], by: list[str] | None = None, sphere: bool = False, leaf: int = LEAF) -> Tree | None:
    """The tree of all sites with both coordinates; None without any. ``places`` has the columns x, y and ``pick``."""
    by = by or []
    own = sites.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*dict.fromkeys([*by, x, y, *pick]))
    box = own.agg(*(f(c) for c in (x, y) for f in (F.min, F.max))).first()
    if box is None or box[0] is None:
        return None
    wide = max(box[1] - box[0], box[3] - box[2]) or 1.0
    axis = lambda c, low: F.least(F.floor((F.col(c) - low) / wide * 2.0**BITS), F.lit(2**BITS - 1))
    key = _spread(axis(x, box[0])).bitwiseOR(F.shiftleft(_spread(axis(y, box[2])), 1))
    places = durable(own.withColumn("_key", key), "places")
    todo = places.groupBy(*by, x, y).agg(F.first("_key").alias("_key"), F.count("*").alias("_n"))
    coords = axes_of(F.col(x), F.col(y), sphere)
    todo = todo.select(*by, "_key", "_n", *(c.alias(f"_p{k}") for k, c in enumerate(coords)))
    cell = lambda k: F.struct(F.lit(k).alias("_level"), F.shiftright("_key", 2 * (BITS - k)).alias("_cell"))
    nodes, level, depth, done = None, 0, 0, [places]
    while True:
        levels = range(level, min(level + PASS * STEP, BITS) + 1, STEP)
        at = todo.select("*", F.explode(F.array(*map(cell, levels))).alias("_c"))
        bounds = [f(f"_p{k}").alias(f"_{n}{k}") for k in range(len(coords)) for n, f in (("lo", F.min), ("hi", F.max))]
        found = durable(at.groupBy(*by, "_c._level", "_c._cell").agg(F.count("*").alias("_places"), F.sum("_n").alias("_sites"), *bounds), "counts")
        done.append(found)
        # a cell is there if its parent is parted; counts only fall, so that holds for all above it
        parted = found.where(F.col("_places") > leaf)
        up = parted.select(*by, (F.col("_level") + STEP).alias("_level"), F.col("_cell").alias("_up"))
        real = found.withColumn("_up", F.shiftright("_cell", 2 * STEP)).join(up, [*by, "_level", "_up"], "left_semi").drop("_up")
        if level == 0:
            real = found.where("_level = 0").unionByName(real)
        nodes = real if nodes is None else nodes.unionByName(real)
        last, deepest = levels[-1], parted.agg(F.max("_level")).first()[0]
        depth = depth if deepest is None else min(deepest + STEP, BITS)
        if last >= BITS or deepest != last:
            break
        large = parted.where(F.col("_level") == last).select(*by, "_cell")
        todo = durable(todo.withColumn("_cell", F.shiftright("_key", 2 * (BITS - last))).join(large, [*by, "_cell"], "left_semi").drop("_cell"), "dense")
        done.append(todo)
        level = last
    nodes = nodes.withColumn("_leaf", (F.col("_places") <= leaf) | (F.col("_level") >= BITS))
    as_child = nodes.withColumns({"_up_level": F.col("_level") - STEP, "_up_cell": F.shiftright("_cell", 2 * STEP), "_go": F.lit(True)})
    as_self = nodes.withColumns({"_up_level": F.col("_level"), "_up_cell": F.col("_cell"), "_go": F.lit(False)})
    nodes = durable(as_child.unionByName(as_self), "nodes")
    leaves = nodes.where("_leaf and not _go").select(*by, "_level", "_cell")
    mine = places.select("*", F.explode(F.array(*map(cell, range(0, depth + 1, STEP)))).alias("_c"))
    placed = mine.select(*own.columns, "_c.*").join(leaves, [*by, "_level", "_cell"], "left_semi")
    out = Tree(nodes, durable(placed, "placed"), by, len(coords), depth)
    for table in done:
        release(table)
    return out


def descend(queries: DataFrame, tree: Tree, pid: list[str], keep: list[str], decide: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The nodes left to each query (``pid``) once all have been decided, from the root down.

    ``decide`` drops rows of queries and nodes, or sets ``_go``: whether the node's children
    are to be looked at. A node without that stays as it is. The queries are dealt out by a
    fixed number: they are few bytes but much work, so their size must not set it.
    """
    if tree.depth:
        queries = queries.repartition(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), *pid)
    own = [*tree.by, *keep]
    root = tree.nodes.where("_level = 0 and not _go").drop("_up_level", "_up_cell", "_go")
    frontier = decide(queries.join(root, tree.by) if tree.by else queries.withColumn("_level", F.lit(0)).join(root, "_level"))
    for _ in range(0, tree.depth, STEP):
        at = frontier.select(*own, F.col("_level").alias("_up_level"), F.col("_cell").alias("_up_cell"), "_go")
        frontier = decide(at.join(tree.nodes, [*tree.by, "_up_level", "_up_cell", "_go"]).drop("_up_level", "_up_cell", "_go"))
    return frontier


def sites_of(frontier: DataFrame, tree: Tree, keep: list[str]) -> DataFrame:
    """The sites of the leaves in ``frontier``."""
    return frontier.select(*tree.by, *keep, "_level", "_cell").join(tree.places, [*tree.by, "_level", "_cell"]).drop("_level", "_cell")


def box_distance(axes: int, farthest: bool) -> Column:
    """Distance of the point _q0, _q1, ... to the nearest or farthest place of a node's box."""
    parts = []
    for k in range(axes):
        q, lo, hi = (F.col(f"{n}{k}") for n in ("_q", "_lo", "_hi"))
        parts.append(F.greatest(F.abs(q - lo), F.abs(q - hi)) if farthest else F.greatest(lo - q, q - hi, F.lit(0.0)))
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def sure_distance(axes: int) -> Column:
    """A distance within which the box holds a place for sure: each of its sides touches one."""
    near, far = [], []
    for k in range(axes):
        q, lo, hi = (F.col(f"{n}{k}") for n in ("_q", "_lo", "_hi"))
        a, b = F.abs(q - lo), F.abs(q - hi)
        near.append(F.least(a, b))
        far.append(F.greatest(a, b))
    sums = []
    for k in range(axes):
        parts = [near[i] if i == k else far[i] for i in range(axes)]
        sums.append(sum((p * p for p in parts[1:]), parts[0] * parts[0]))
    return F.sqrt(F.least(*sums))


def metres(chord: Column, farthest: bool) -> Column:
    """Bounds on geodesic metres by the chord of a unit sphere."""
    arc = 2 * EARTH_RADIUS_M * F.asin(F.least(chord / 2, F.lit(1.0)))
    return arc * (1 + ELLIPSOID if farthest else 1 - ELLIPSOID)


def candidates(points: DataFrame, tree: Tree, pid: list[str], at: tuple[str, str], k: int = 1, most: float | None = None, sphere: bool = False) -> DataFrame:
    """Each point with the sites of all leaves that may hold one of its ``k`` nearest.

    A node stays if its nearest place is no farther than where k places are for sure, and
    no farther than ``most``.
    """
    slack = lambda c: c * (1 + 1e-9) + 1e-9
    q = axes_of(F.col(at[1]), F.col(at[0]), sphere)
    start = points.where(F.col(at[0]).isNotNull() & F.col(at[1]).isNotNull()).select(*dict.fromkeys([*pid, *at]), *(c.alias(f"_q{n}") for n, c in enumerate(q)))
    own = [*dict.fromkeys(c for c in (*pid, *at) if c not in tree.by), *(f"_q{n}" for n in range(tree.axes))]
    per = W.partitionBy(*pid)
    far = sure_distance(tree.axes) if k == 1 else box_distance(tree.axes, True)
    bound = lambda d, f: metres(d, f) if sphere else d

    def pruned(rows: DataFrame) -> DataFrame:
        rows = rows.withColumns({"_near": bound(box_distance(tree.axes, False), False), "_far": slack(bound(far, True))})
        if most is not None:
            rows = rows.where(F.col("_near") <= slack(F.lit(float(most))))
        if k == 1:
            sure = F.min("_far").over(per)
        else:  # the far side of the node by which k places are reached
            rows = rows.withColumn("_sum", F.sum("_places").over(per.orderBy("_far", "_level", "_cell").rowsBetween(W.unboundedPreceding, 0)))
            sure = F.coalesce(F.min(F.when(F.col("_sum") >= k, F.col("_far"))).over(per), F.lit(float("inf")))
        left = rows.withColumn("_sure", sure).where(F.col("_near") <= F.col("_sure"))
        return left.withColumn("_go", ~F.col("_leaf")).drop("_near", "_far", "_sum", "_sure")

    return sites_of(descend(start, tree, pid, own, pruned), tree, own)


def knn(points: DataFrame, tree: Tree, pid: list[str], at: tuple[str, str], to: tuple[str, str], pick: list[str], distance: Callable[..., Column], k: int = 1, most: float | None = None, sphere: bool = False, settled: Callable[..., Column] | None = None) -> DataFrame:
    """pid, pick, dist_m and rank of each point's ``k`` nearest sites, ties by ``pick``.

    Where engines round ``distance`` differently, ``settled`` is the one that orders the sites:
    it is asked only for those that may be among the k by it.

    ``at`` and ``to`` name y and x (latitude and longitude), all four different. ``pid`` is
    unique and holds tree.by. Only sites within ``most`` count.
    """
    found = candidates(points, tree, pid, at, k, most, sphere).withColumn("dist_m", distance(*map(F.col, (*at, *to))))
    if most is not None:
        found = found.where(F.col("dist_m") <= (most if settled is None else most + ROUNDING_M))
    if settled is not None:
        by = W.partitionBy(*pid)
        nth = found.withColumn("_n", F.row_number().over(by.orderBy("dist_m")))
        near = nth.withColumn("_far", F.max(F.when(F.col("_n") <= k, F.col("dist_m"))).over(by)).where(F.col("dist_m") <= F.col("_far") + ROUNDING_M)
        found = near.drop("_n", "_far").withColumn("dist_m", settled(*map(F.col, (*at, *to))))
        if most is not None:
            found = found.where(F.col("dist_m") <= most)
    if k == 1:
        best = found.groupBy(*pid).agg(F.min(F.struct("dist_m", *pick)).alias("best"))
        return best.select(*pid, *(F.col(f"best.{c}").alias(c) for c in ("dist_m", *pick)), F.lit(1).alias("rank"))
    order = W.partitionBy(*pid).orderBy("dist_m", *pick)
    return found.select(*pid, "dist_m", *pick).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
