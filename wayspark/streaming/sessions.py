"""Move sessions over a stream of points (an extension; the batch form is move_sessions)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_moves(points: DataFrame, min_gap_s: int = 900, late: str = "1 hour") -> DataFrame:
    """participant_id, start_time, end_time, n_points, first and last place of each session.

    Works on batch and streaming frames with a timestamp column ts; a stream gives a session
    once the watermark has passed its end.
    """
    rows = points.withWatermark("ts", late) if points.isStreaming else points
    at = F.struct("ts", "event_id")
    place = F.struct("lat", "lon")
    out = rows.groupBy("participant_id", F.session_window("ts", f"{min_gap_s} seconds")).agg(
        F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.count("*").alias("n_points"),
        F.min_by(place, at).alias("origin"), F.max_by(place, at).alias("dest"),
    )
    return out.select("participant_id", "start_time", "end_time", "n_points", F.col("origin.lat").alias("lat_origin"), F.col("origin.lon").alias("lon_origin"), F.col("dest.lat").alias("lat_dest"), F.col("dest.lon").alias("lon_dest"))
