"""Home and Work among stops, distances to them, confidence and activities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wayspark.functions.geo import geodesic_m, mercator_x, mercator_y, planar_m
from wayspark.operators.joins import interval_pairs, within_radius

OTHER = "autre"
HOME_HOURS, WORK_HOURS = (20, 8), (7, 19)


def window_hours(h0: int, h1: int) -> list[int]:
    """Whole hours from h0 up to h1, over midnight if h0 is larger."""
    return list(range(h0, h1)) if h0 < h1 else [*range(h0, 24), *range(h1)]


def covers_window(hours: tuple[int, int], cross_midnight: bool = False) -> Column:
    """Whether the stop covers one of the window's hours on the date of its start.

    With ``cross_midnight`` the hours of the next date count too, so that a stop from 23:10 to
    5:00 covers hours of the night.
    """
    day = F.date_trunc("day", F.col("start_time")).cast("timestamp_ntz")
    at = window_hours(*hours)
    return F.exists(F.array(*map(F.lit, at + [24 + h for h in at] if cross_midnight else at)), lambda h: (day + F.make_dt_interval(F.lit(0), h)).between(F.col("start_time"), F.col("end_time")))


def top_zone(stops: DataFrame, hours: tuple[int, int], digits: int = 3) -> DataFrame:
    """participant_id, zone_lat, zone_lon, zone_s: the rounded place with the longest stay in the window."""
    zones = stops.where(covers_window(hours)).groupBy("participant_id", F.bround("lat", digits).alias("zone_lat"), F.bround("lon", digits).alias("zone_lon")).agg(F.sum("duration_s").alias("zone_s"))
    best = W.partitionBy("participant_id").orderBy(F.desc("zone_s"), "zone_lat", "zone_lon")
    return zones.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def _in_zone(stops: DataFrame, zone: DataFrame, radius_m: float) -> DataFrame:
    near = geodesic_m(F.col("lat"), F.col("lon"), F.col("zone_lat"), F.col("zone_lon")) <= radius_m
    return stops.join(zone.drop("zone_s"), "participant_id", "left").withColumn("_in", F.coalesce(near, F.lit(False))).drop("zone_lat", "zone_lon")


def classify_home(stops: DataFrame, hours: tuple[int, int] = HOME_HOURS, radius_m: float = 100.0) -> DataFrame:
    """Adds place_type: Home near the top night zone, else other."""
    return _in_zone(stops, top_zone(stops, hours), radius_m).withColumn("place_type", F.when(F.col("_in"), "Home").otherwise(OTHER)).drop("_in")


def classify_home_work(stops: DataFrame, home: tuple[int, int] = HOME_HOURS, work: tuple[int, int] = WORK_HOURS, radius_m: float = 100.0) -> DataFrame:
    """Adds place_type and the visits' times as lists; Work is found among the rest and overrides Home."""
    homes = classify_home(stops, home, radius_m)
    zone = top_zone(homes.where(F.col("place_type") == OTHER), work)
    out = _in_zone(homes, zone, radius_m).withColumn("place_type", F.when(F.col("_in"), "Work").otherwise(F.col("place_type"))).drop("_in")
    text = lambda c: F.array(F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    return out.withColumns({"merged_starts": text("start_time"), "merged_ends": text("end_time")})


def first_of(stops: DataFrame, kind: str, name: str) -> DataFrame:
    return stops.where(F.col("place_type") == kind).groupBy("participant_id").agg(F.min_by(F.struct("lat", "lon"), "stop_seq").alias(name))


def other_place_distances(stops: DataFrame, suspect_m: float = 150.0) -> DataFrame:
    """Other places with their distance to Home and Work; none without both."""
    both = first_of(stops, "Home", "home").join(first_of(stops, "Work", "work"), "participant_id")
    to = lambda c: geodesic_m(F.col("lat"), F.col("lon"), F.col(f"{c}.lat"), F.col(f"{c}.lon"))
    out = stops.where(F.col("place_type") == OTHER).join(both, "participant_id").withColumn("dist_home_m", to("home")).withColumn("dist_work_m", to("work"))
    close = (F.col("dist_home_m") < suspect_m) | (F.col("dist_work_m") < suspect_m)
    return out.select("participant_id", "stop_seq", "lat", "lon", "dist_home_m", "dist_work_m", F.when(close, "Oui").otherwise("Non").alias("suspect")).orderBy("participant_id", "dist_home_m", "stop_seq")


def confidence(visits: DataFrame) -> DataFrame:
    """Home and Work places (place_id) with ``confidence``: mean of the shares of the longest stay and most days.

    ``visits`` has one row for each visit, so no place's visits are collected.
    """
    kept = visits.where(F.col("place_type").isin("Home", "Work")).groupBy("participant_id", "place_id", "place_type").agg(
        F.sum("duration_s").alias("duration_s"), F.count_distinct(F.to_date("start_time")).cast("int").alias("days"),
    )
    w = W.partitionBy("participant_id")
    share = lambda c: F.try_divide(F.col(c), F.max(c).over(w))
    return kept.withColumn("confidence", F.round(100 * (share("duration_s") + share("days")) / 2, 1))


def stop_activity(stops: DataFrame, activities: DataFrame) -> DataFrame:
    """Adds ``matched_activity``: the first activity within the stop's times, else other."""
    spans = stops.select("participant_id", "stop_seq", "start_time", "end_time")
    events = activities.select("participant_id", F.col("ts").alias("at"), "activity")
    found = interval_pairs(events, spans, "participant_id", "at", "start_time", "end_time").groupBy("participant_id", "stop_seq").agg(F.min_by("activity", F.struct("at", "activity")).alias("matched_activity"))
    return stops.join(found, ["participant_id", "stop_seq"], "left").fillna(OTHER, ["matched_activity"])


def activity_minutes(matched: DataFrame) -> DataFrame:
    """Minutes by participant and activity, the longest first."""
    return matched.groupBy("participant_id", "matched_activity").agg((F.sum("duration_s") / 60).alias("total_min")).orderBy("participant_id", F.desc("total_min"), "matched_activity")


def nearest_place(stops: DataFrame, classified: DataFrame, max_units: float = 150.0) -> DataFrame:
    """Each stop with its nearest classified places within ``max_units`` of EPSG:3857; ties repeat it."""
    left = stops.withColumns({"x": mercator_x(F.col("lon")), "y": mercator_y(F.col("lat"))})
    right = classified.select("participant_id", F.col("stop_seq").alias("place_seq"), F.col("place_type").alias("near_type"), mercator_x(F.col("lon")).alias("px"), mercator_y(F.col("lat")).alias("py"))
    distance = lambda y1, x1, y2, x2: planar_m(x1, y1, x2, y2)
    near = within_radius(left.select("participant_id", "stop_seq", "x", "y"), right, max_units, distance, "participant_id", ("y", "x"), ("py", "px"), planar=True)
    best = near.withColumn("_r", F.rank().over(W.partitionBy("participant_id", "stop_seq").orderBy("dist_m"))).where("_r = 1")
    return stops.join(best.select("participant_id", "stop_seq", "place_seq", "near_type", F.col("dist_m").alias("units")), ["participant_id", "stop_seq"], "left")
