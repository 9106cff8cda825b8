"""Preparing GPS points: steps, speeds, filters, cleaning and calendar columns.

Points have participant_id, event_id, ts (local wall clock), lat, lon. Windows are per
participant, ordered by ts and event_id.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec

from wayspark.functions.geo import EARTH_RADIUS_M, geodesic_m
from wayspark.operators.chain import CHUNK, follow
from wayspark.operators.spans import SPAN_S, in_spans, with_span, within


def by_time() -> WindowSpec:
    return W.partitionBy("participant_id").orderBy("ts", "event_id")


def to_local(ts: Column, zone: str = "Europe/Paris") -> Column:
    """Wall clock in ``zone`` of a UTC wall clock."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def with_steps(points: DataFrame, window: WindowSpec | None = None) -> DataFrame:
    """Adds time_diff_s, dist_m and speed_kmh since the row before; null on the first row.

    A step without duration has no speed.
    """
    before = {c: F.lag(c).over(window or by_time()) for c in ("ts", "lat", "lon")}
    return (
        points.withColumn("time_diff_s", (micros(F.col("ts")) - micros(before["ts"])) / 1_000_000)
        .withColumn("dist_m", geodesic_m(before["lat"], before["lon"], F.col("lat"), F.col("lon")))
        .withColumn("speed_kmh", F.try_divide("dist_m", "time_diff_s") * 3.6)
    )


def drop_fast(steps: DataFrame, max_speed_kmh: float = 150.0) -> DataFrame:
    """Rows without a speed or at most as fast; steps aren't computed anew."""
    return steps.where(F.col("speed_kmh").isNull() | (F.col("speed_kmh") <= max_speed_kmh))


def with_smooth_speed(steps: DataFrame, window: int = 5, track: WindowSpec | None = None) -> DataFrame:
    """Mean speed of a window centred on the row; an even window reaches further back."""
    return steps.withColumn("speed_kmh_smooth", F.avg("speed_kmh").over((track or by_time()).rowsBetween(-(window // 2), (window - 1) // 2)))


def prepared(points: DataFrame, max_speed_kmh: float = 150.0) -> DataFrame:
    """Steps, the speed filter and the smoothed speed, over one exchange."""
    return with_smooth_speed(drop_fast(with_steps(points), max_speed_kmh))


def steps_in_spans(points: DataFrame, seconds: int = SPAN_S) -> DataFrame:
    """Like :func:`with_steps`, for tracks too long for one task each (see spans)."""
    return in_spans(points, with_steps, before=1, seconds=seconds)


def prepared_in_spans(points: DataFrame, max_speed_kmh: float = 150.0, window: int = 5, seconds: int = SPAN_S) -> DataFrame:
    """Like :func:`prepared`, for tracks too long for one task each."""
    kept = drop_fast(within(with_span(points, "ts", seconds), with_steps, before=1), max_speed_kmh)
    return within(kept, lambda rows, track: with_smooth_speed(rows, window, track), window // 2, (window - 1) // 2).drop("_span")


def with_calendar(points: DataFrame) -> DataFrame:
    """Adds hour, weekday, weekday_num (Monday 0), date and is_weekend."""
    day = F.weekday("ts")
    return points.withColumns({
        "hour": F.hour("ts"), "weekday": F.date_format("ts", "EEEE"), "weekday_num": day, "date": F.to_date("ts"), "is_weekend": day >= 5,
    })


def in_box(points: DataFrame, lat: tuple[float, float], lon: tuple[float, float]) -> DataFrame:
    """Points strictly inside the box."""
    return points.where((F.col("lat") > lat[0]) & (F.col("lat") < lat[1]) & (F.col("lon") > lon[0]) & (F.col("lon") < lon[1]))


def clean_light(points: DataFrame) -> DataFrame:
    """Rows without nulls, one of each (participant, time, place): that with the least event_id."""
    same = W.partitionBy("participant_id", "ts", "lat", "lon").orderBy("event_id")
    whole = points.dropna(subset=["participant_id", "ts", "lat", "lon"])
    return whole.withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")


def clean_full(points: DataFrame, min_dist_m: float = 1.0, min_time_s: float = 30.0, gap_s: float = 7200.0) -> DataFrame:
    """Light cleaning, then steps of at least both bounds (or first rows), computed anew; ``long_gap`` marks gaps."""
    kept = with_steps(clean_light(points)).where(F.col("dist_m").isNull() | ((F.col("dist_m") >= min_dist_m) & (F.col("time_diff_s") >= min_time_s)))
    return with_steps(kept.select(*points.columns)).withColumn("long_gap", F.coalesce(F.col("time_diff_s") > gap_s, F.lit(False)))


def date_segments(points: DataFrame) -> DataFrame:
    """participant_id, first_date, last_date, n_days of consecutive days with data."""
    days = points.select("participant_id", F.to_date("ts").alias("date")).distinct()
    island = F.date_sub("date", F.row_number().over(W.partitionBy("participant_id").orderBy("date")))
    return days.withColumn("_g", island).groupBy("participant_id", "_g").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("n_days")).drop("_g")


def haversine(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    """Metres, for the few operators whose next step depends on the last."""
    p, q = math.radians(lat1), math.radians(lat2)
    a = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS_M * math.asin(min(1.0, math.sqrt(a)))


def in_order(points: DataFrame, columns: list[str]) -> DataFrame:
    """Whole participants in one partition each, rows by time: a task reads them as a stream."""
    return points.select(*columns).repartition("participant_id").sortWithinPartitions("participant_id", "ts", "event_id")


def drop_fast_since_kept(points: DataFrame, max_speed_kmh: float = 150.0, chunk: int = CHUNK) -> DataFrame:
    """Drops points faster than the bound since the last point *kept*.

    The points kept are the references of a chain (see chain), so a long track is cut into chunks.
    """
    speed = max_speed_kmh / 3.6
    kept = follow(points, lambda ref, ts, lat, lon: haversine(*ref[2:], lat, lon) <= speed * (ts - ref[1]).total_seconds(), chunk=chunk)
    return kept.where("is_ref").select("participant_id", "event_id", "ts", "lat", "lon")
