"""Stays over a stream of points, as the anchor detector finds them in a table.

The points of a participant wait in its state until the watermark has passed them, so rows
may come in any order within ``late``; they are then followed in the order of time. The state
is what waits, the anchor and the places of the stay so far. A timer at the last waiting point
wakes the state when no further rows come. Rows later than the watermark are left out, as in
any stream.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wayspark.operators.points import haversine
from wayspark.operators.stops import stops_anchor

_OUT = "participant_id long, start_us long, end_us long, lat double, lon double"


class Stays(StatefulProcessor):
    """Waiting points by (time, event), the anchor, and the places since."""

    def __init__(self, min_time_s: float, radius_m: float):
        self.min_us, self.radius = int(min_time_s * 1_000_000), radius_m

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "us long, event long", "lat double, lon double")
        self.anchor = handle.getValueState("anchor", "us long, lat double, lon double")
        self.held = handle.getListState("held", "lat double, lon double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = None
        for df in rows:
            for us, event, lat, lon in zip(df["ts_us"], df["event_id"], df["lat"], df["lon"], strict=True):
                self.waiting.updateValue((int(us), int(event)), (float(lat), float(lon)))
                last = int(us) if last is None else max(last, int(us))
        if last is not None:
            self.handle.registerTimer(last // 1000 + 1)
        yield self._follow(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._follow(key, timerValues.getCurrentWatermarkInMs())

    def _follow(self, key, watermark_ms: int) -> pd.DataFrame:
        """Take what the watermark has passed, in order."""
        ready = sorted((k, v) for k, v in self.waiting.iterator() if k[0] <= watermark_ms * 1000)
        out, fresh = [], []
        if ready:
            anchor = self.anchor.get() if self.anchor.exists() else None
            held = None
            for (us, event), (lat, lon) in ready:
                if anchor is not None and haversine(*anchor[1:], lat, lon) > self.radius:
                    if us - anchor[0] > self.min_us:
                        held = list(self.held.get()) if held is None else held
                        stay = [*held, *fresh]
                        out.append((key[0], anchor[0], us, float(median(p[0] for p in stay)), float(median(p[1] for p in stay))))
                    self.held.clear()
                    anchor, held, fresh = None, [], []
                anchor = anchor or (us, lat, lon)
                fresh.append((lat, lon))
                self.waiting.removeKey((us, event))
            self.anchor.update(tuple(anchor))
            if fresh:
                self.held.appendList(fresh)
        return pd.DataFrame(out, columns=["participant_id", "start_us", "end_us", "lat", "lon"])

    def close(self) -> None:
        pass


def stays(points: DataFrame, min_time_s: float = 300.0, radius_m: float = 100.0, late: str = "1 hour") -> DataFrame:
    """participant_id, start_time, end_time, duration_s, lat, lon of each stay.

    Works on batch and streaming frames with a timestamp column ts; a stream gives a stay once
    the watermark has passed the point that ends it. It needs the RocksDB state store.
    """
    if not points.isStreaming:
        return stops_anchor(points.withColumn("ts", F.col("ts").cast("timestamp_ntz")), min_time_s, radius_m).withColumns({c: F.col(c).cast("timestamp") for c in ("start_time", "end_time")})
    rows = points.select(F.col("participant_id").cast("long").alias("participant_id"), F.col("event_id").cast("long").alias("event_id"), "ts", "lat", "lon").withWatermark("ts", late)
    rows = rows.where("lat is not null and lon is not null").withColumn("ts_us", F.unix_micros("ts"))
    found = rows.groupBy("participant_id").transformWithStateInPandas(statefulProcessor=Stays(min_time_s, radius_m), outputStructType=_OUT, outputMode="Append", timeMode="EventTime")
    return found.select(
        "participant_id", F.timestamp_micros("start_us").alias("start_time"), F.timestamp_micros("end_us").alias("end_time"), ((F.col("end_us") - F.col("start_us")) / 1_000_000).alias("duration_s"), "lat", "lon",
    )
