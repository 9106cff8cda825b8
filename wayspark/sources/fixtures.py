"""GPS-like tables derived from the events and supplier tables.

Coordinates come from whole-number arithmetic with one division last, so every engine gets
the same doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wayspark.functions.geo import mercator_x, mercator_y
from wayspark.operators.points import by_time

PLACE_LAT = (0, 300_000, 110_000, 170_000, 230_000)
PLACE_LON = (0, 400_000, 130_000, 210_000, 290_000)


def participant(user: Column) -> Column:
    """Four participants for every 20 users, one of 12 of them and three of two or three."""
    return F.floor(user / 20) * 4 + F.when(user % 20 < 12, 0).otherwise(1 + user % 3)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, participant_id, ts, place, lat, lon: participants between 5 places, in one of 4 towns each."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    h, d = F.hour("ts"), F.weekday("ts") + 1
    place = F.when((h >= 20) | (h < 8), 0).when((d <= 5) & (h >= 9) & (h <= 17), 1).otherwise(2 + F.col("event_id") % 3).cast("int")
    at = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("place") + 1)
    jitter = lambda k: ((F.col("event_id") * k) % 1000 - 500) * 4
    pid = F.col("participant_id") % 4
    return e.withColumn("participant_id", participant(F.col("user_id"))).withColumn("place", place).select(
        "event_id", "participant_id", "ts", "place",
        ((488_000_000 + 500_000 * pid + at(PLACE_LAT) + jitter(7919)).cast("double") / 1e7).alias("lat"),
        ((23_000_000 + 500_000 * pid + at(PLACE_LON) + jitter(104_729)).cast("double") / 1e7).alias("lon"),
    )


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """participant_id, ts, activity: every tenth event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id % 10 = 0")
    return e.select(participant(F.col("user_id")).alias("participant_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_type").alias("activity"))


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of points at one place: stop_seq, place, start_time, end_time, duration_s, lat, lon."""
    changed = F.when(F.col("place") == F.lag("place").over(by_time()), 0).otherwise(1)
    runs = points(spark, sf_dir).withColumn("_c", changed).withColumn("stop_seq", F.sum("_c").over(by_time()))
    return runs.groupBy("participant_id", "stop_seq").agg(
        F.first("place").alias("place"), F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"),
    ).withColumn("duration_s", (F.unix_micros(F.col("end_time").cast("timestamp")) - F.unix_micros(F.col("start_time").cast("timestamp"))) / 1_000_000)


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site_id, x, y, cluster_id in the plane of the trajectories."""
    k = F.col("s_suppkey")
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        k.alias("site_id"), (256_000 + 2.2 * ((k * 7919) % 10_007)).alias("x"), (6_245_000 + 3.2 * ((k * 104_729) % 10_009)).alias("y"),
        (F.col("s_nationkey") + 1).cast("long").alias("cluster_id"),
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region_id and ring: a chevron over each site, of sizes from some hundred metres to some kilometres."""
    k = F.col("site_id")
    sized = sites(spark, sf_dir).withColumns({"w": (300 + (k * 37) % 2900).cast("double"), "h": (200 + (k * 53) % 1700).cast("double")})
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y, w, h = map(F.col, "xywh")
    return sized.select(k.alias("region_id"), F.array(at(x - w, y), at(x, y + h), at(x + w, y), at(x, y + h / 4)).alias("ring"))


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """traj_id (participant and day), pos, ts, event_id, x, y."""
    p = points(spark, sf_dir)
    traj = F.concat_ws("-", F.col("participant_id").cast("string"), F.date_format("ts", "yyyyMMdd"))
    w = W.partitionBy("traj_id").orderBy("ts", "event_id")
    return p.select(traj.alias("traj_id"), "ts", "event_id", mercator_x(F.col("lon")).alias("x"), mercator_y(F.col("lat")).alias("y")).withColumn("pos", F.row_number().over(w).cast("long"))
