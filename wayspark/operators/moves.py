"""Moves between stops: extraction, summary, tagging by place, filters and snapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wayspark.functions.durable import durable
from wayspark.functions.geo import geodesic_m, settled_geodesic_m
from wayspark.operators import quadtree
from wayspark.operators.cluster import by_start
from wayspark.operators.joins import inside, interval_pairs
from wayspark.operators.points import by_time, micros
from wayspark.operators.spans import SPAN_S, in_spans, running_sum

ARROW = " → "


def seconds(start: Column, end: Column) -> Column:
    return (micros(end) - micros(start)) / 1_000_000


def _ends(by: list[str], rows: DataFrame) -> DataFrame:
    """First and last point of each group, with at least two points."""
    at = F.struct("ts", "event_id")
    return (
        rows.groupBy(*by).agg(
            F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.count("*").alias("n"),
            F.min_by("lat", at).alias("lat_origin"), F.min_by("lon", at).alias("lon_origin"), F.max_by("lat", at).alias("lat_dest"), F.max_by("lon", at).alias("lon_dest"),
        ).where("n >= 2").withColumn("duration_s", seconds(F.col("start_time"), F.col("end_time"))).drop("n")
    )


_MOVE = ["participant_id", "start_time", "end_time", "duration_s", "lat_origin", "lon_origin", "lat_dest", "lon_dest"]


def moves_between_stops(points: DataFrame, stops: DataFrame, min_duration_s: float = 30.0, min_gap_s: float = 900.0) -> DataFrame:
    """Moves in the gaps before each stop, both ends included; participants without stops have none."""
    firsts = points.groupBy("participant_id").agg(F.min("ts").alias("first_ts"))
    gaps = (
        stops.join(firsts, "participant_id").select(
            "participant_id", F.col("stop_seq").alias("gap_id"), F.coalesce(F.lag("end_time").over(by_start()), "first_ts").alias("gap_start"), F.col("start_time").alias("gap_end"),
        ).where(seconds(F.col("gap_start"), F.col("gap_end")) >= min_gap_s)
    )
    found = interval_pairs(points, gaps, "participant_id", "ts", "gap_start", "gap_end")
    return _ends(["participant_id", "gap_id"], found).where(F.col("duration_s") >= min_duration_s).select(*_MOVE)


def moves_tail(points: DataFrame, stops: DataFrame, min_duration_s: float = 30.0) -> DataFrame:
    """The move after each participant's last stop, without a test of the gap."""
    last = stops.groupBy("participant_id").agg(F.max_by("end_time", F.struct("start_time", "stop_seq")).alias("last_end"))
    return _ends(["participant_id"], points.join(last, "participant_id").where("ts >= last_end")).where(F.col("duration_s") >= min_duration_s).select(*_MOVE)


def moves(points: DataFrame, stops: DataFrame) -> DataFrame:
    """All moves of the live pipeline."""
    return moves_between_stops(points, stops).unionByName(moves_tail(points, stops))


def split_points(points: DataFrame, stops: DataFrame, moving: bool) -> DataFrame:
    """Points outside every stop (``moving``) or inside one."""
    return inside(points, stops, "participant_id", "ts", "start_time", "end_time", keep=not moving)


def move_sessions(points: DataFrame, min_gap_s: float = 900.0) -> DataFrame:
    """Adds ``move_id``: a new move begins after a gap of more than ``min_gap_s``."""
    gap = seconds(F.lag("ts").over(by_time()), F.col("ts"))
    return points.withColumn("_new", F.when(gap > min_gap_s, 1).otherwise(0)).withColumn("move_id", F.sum("_new").over(by_time())).drop("_new")


def move_sessions_in_spans(points: DataFrame, min_gap_s: float = 900.0, span_s: int = SPAN_S) -> DataFrame:
    """Like :func:`move_sessions`, for tracks too long for one task each (see spans)."""
    gap = lambda w: seconds(F.lag("ts").over(w), F.col("ts"))
    flagged = in_spans(points, lambda rows, w: rows.withColumn("_new", F.when(gap(w) > min_gap_s, 1).otherwise(0)), before=1, seconds=span_s)
    return running_sum(flagged, "_new", "move_id", seconds=span_s).drop("_new")


def moves_summary(points: DataFrame, min_duration_s: float = 60.0, min_gap_s: float = 1800.0) -> DataFrame:
    """One row for each session of at least two points and the duration, with its distance."""
    return with_distance(_ends(["participant_id", "move_id"], move_sessions(points, min_gap_s)).where(F.col("duration_s") >= min_duration_s))


def with_distance(moves: DataFrame) -> DataFrame:
    return moves.withColumn("dist_m", geodesic_m(*map(F.col, ("lat_origin", "lon_origin", "lat_dest", "lon_dest"))))


def nearest_places(ends: DataFrame, stops: DataFrame, max_dist_m: float = 200.0, k: int = 1) -> DataFrame:
    """The ``k`` nearest stops within the radius of each move end (move_id, side, lat, lon), with rank.

    Ties go to the smaller stop_seq; several are in the order of distances as the C library
    rounds them, which SQL engines use. The ends go down a quadtree of their participant's
    stops, so that an end at a place of many visits isn't joined with them all.
    """
    key = ["participant_id", "move_id", "side"]
    sites = stops.select("participant_id", "stop_seq", "place_type", F.col("lat").alias("lat_s"), F.col("lon").alias("lon_s"))
    tree = quadtree.build(sites, "lon_s", "lat_s", ["stop_seq", "place_type"], ["participant_id"], sphere=True)
    if tree is None:
        return ends.select(*key).withColumns({c: F.lit(None).cast(t) for c, t in (("stop_seq", "long"), ("place_type", "string"), ("dist_m", "double"), ("rank", "int"))}).limit(0)
    return quadtree.knn(ends, tree, key, ("lat", "lon"), ("lat_s", "lon_s"), ["stop_seq", "place_type"], geodesic_m, k, max_dist_m, sphere=True, settled=settled_geodesic_m if k > 1 else None)


def ends_of(numbered: DataFrame) -> DataFrame:
    """Two rows for each move (with move_id): side, lat, lon."""
    side = lambda s, c: F.struct(F.lit(s).alias("side"), F.col(f"lat_{c}").alias("lat"), F.col(f"lon_{c}").alias("lon"))
    return numbered.select("participant_id", "move_id", F.explode(F.array(side("origin", "origin"), side("destination", "dest"))).alias("e")).select("participant_id", "move_id", "e.*")


def numbered(moves: DataFrame) -> DataFrame:
    """Adds ``move_id`` by start time per participant."""
    return moves.withColumn("move_id", F.row_number().over(W.partitionBy("participant_id").orderBy("start_time", "end_time")).cast("long"))


def tag_moves(moves: DataFrame, stops: DataFrame, max_dist_m: float = 200.0) -> DataFrame:
    """Adds origin_type, destination_type (``unknown`` without a stop near) and transition."""
    own = durable(numbered(moves) if "move_id" not in moves.columns else moves, "moves")
    near = nearest_places(ends_of(own), stops, max_dist_m).groupBy("participant_id", "move_id").agg(
        *(F.max(F.when(F.col("side") == s, F.col("place_type"))).alias(f"{s}_type") for s in ("origin", "destination"))
    )
    return own.join(near, ["participant_id", "move_id"], "left").fillna("unknown", ["origin_type", "destination_type"]).withColumn("transition", F.concat_ws(ARROW, "origin_type", "destination_type"))


def real_moves(tagged: DataFrame, min_dist_m: float = 50.0, max_duration_s: float = 21_600.0) -> DataFrame:
    """Moves far enough, short enough and between different types."""
    return with_distance(tagged).where((F.col("dist_m") >= min_dist_m) & (F.col("duration_s") <= max_duration_s) & (F.col("origin_type") != F.col("destination_type")))


def snap_moves(moves: DataFrame, stops: DataFrame, max_dist_m: float = 150.0) -> DataFrame:
    """Ends near Home, else Work, take its place; nothing changes unless the participant has both."""
    first = stops.where(F.col("place_type").isin("Home", "Work")).groupBy("participant_id").agg(
        *(F.min_by(F.struct("lat", "lon"), F.when(F.col("place_type") == t, F.col("stop_seq"))).alias(t) for t in ("Home", "Work"))
    ).where("Home is not null and Work is not null")
    out = moves.join(first, "participant_id", "left")
    for name, c in (("origin", "origin"), ("destination", "dest")):
        near = lambda t, c=c: F.coalesce(geodesic_m(F.col(f"lat_{c}"), F.col(f"lon_{c}"), F.col(f"{t}.lat"), F.col(f"{t}.lon")) <= max_dist_m, F.lit(False))
        out = out.withColumn(f"snapped_{name}_type", F.when(near("Home"), "Home").when(near("Work"), "Work"))
    for name, c in (("origin", "origin"), ("destination", "dest")):
        kind = F.col(f"snapped_{name}_type")
        for axis in ("lat", "lon"):
            out = out.withColumn(f"{axis}_{c}", F.when(kind == "Home", F.col(f"Home.{axis}")).when(kind == "Work", F.col(f"Work.{axis}")).otherwise(F.col(f"{axis}_{c}")))
    return out.withColumn("snapped", F.col("snapped_origin_type").isNotNull() | F.col("snapped_destination_type").isNotNull()).drop("Home", "Work")
