"""Stop detection, where each decision depends on the ones before.

The anchor detector follows a chain over chunks of a track. The sliding one reads the points
of a participant as a stream; it holds the points of one stay, never a whole trajectory."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from statistics import median

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayspark.functions.durable import durable
from wayspark.operators.chain import CHUNK, follow
from wayspark.operators.points import haversine, in_order, micros

STOPS = "participant_id long, start_time timestamp_ntz, end_time timestamp_ntz, duration_s double, lat double, lon double"
_COLUMNS = ["participant_id", "event_id", "ts", "lat", "lon"]
_DEGREE_M = 111_195.08


def _hull(xy: list[tuple[float, float]]) -> list[tuple[float, float]]:
    pts = sorted(set(xy))
    if len(pts) < 3:
        return pts
    out: list[tuple[float, float]] = []
    for half in (pts, pts[::-1]):
        part: list[tuple[float, float]] = []
        for p in half:
            while len(part) > 1 and (part[-1][0] - part[-2][0]) * (p[1] - part[-2][1]) <= (part[-1][1] - part[-2][1]) * (p[0] - part[-2][0]):
                part.pop()
            part.append(p)
        out += part[:-1]
    return out


def _planar(lat: float, lon: float, lat0: float) -> tuple[float, float]:
    return lon * _DEGREE_M * float(np.cos(np.radians(lat0))), lat * _DEGREE_M


def box_diagonal(hull: list[tuple[float, float]]) -> float:
    """Diagonal of the smallest rectangle, at any angle, around a convex hull."""
    at = np.array(hull)
    if len(at) < 3:
        return float(np.hypot(*(at[-1] - at[0])))
    edge = np.roll(at, -1, axis=0) - at
    unit = edge / np.hypot(edge[:, 0], edge[:, 1])[:, None]
    spans = [np.ptp(at @ np.stack([u, (-u[1], u[0])], axis=1), axis=0) for u in unit]
    w, h = min(spans, key=lambda s: s[0] * s[1])
    return float(np.hypot(w, h))


def _streamed(points: DataFrame, start, step, finish) -> DataFrame:
    """Runs ``step`` on each point with a participant's state; both yield stops."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid, state = None, None
        for df in frames:
            out = []
            for row in zip(*(df[c] for c in _COLUMNS if c != "event_id"), strict=True):
                if row[0] != pid:
                    out += finish(pid, state) if state is not None else []
                    pid, state = row[0], start()
                out += step(pid, state, row[1:])
            yield _frame(out)
        if state is not None:
            yield _frame(finish(pid, state))

    return in_order(points, _COLUMNS).mapInPandas(run, STOPS)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["participant_id", "start_time", "end_time", "duration_s", "lat", "lon"])


def _stop(pid, points: list[tuple], end) -> tuple:
    begin = points[0][0]
    return pid, begin, end, (end - begin).total_seconds(), float(median(p[1] for p in points)), float(median(p[2] for p in points))


def stops_sliding(points: DataFrame, min_duration_s: float = 300.0, max_diameter_m: float = 100.0) -> DataFrame:
    """Stays of at least ``min_duration_s`` within a region of less than ``max_diameter_m``.

    A buffer follows the points. Outside a stop it is cut from the front while it holds more
    than two points and spans the duration. It is stopped if it then holds more than one
    point and the smallest rectangle around it has a diagonal below the diameter. When that
    ends, the stop is from its first point to the last but one; if that is long enough it is
    given and the buffer cleared. A stop open at the end is given if it is long enough. The
    place is the median of the points.
    """

    # A rectangle around the points is as long as any of their extents, and its sides are at
    # most the diagonal of the box along the axes: between these bounds the hull decides.
    def within(s) -> bool:
        x0, x1, y0, y1 = s["box"]
        if max(x1 - x0, y1 - y0) >= max_diameter_m:
            return False
        if 2**0.5 * np.hypot(x1 - x0, y1 - y0) < max_diameter_m:
            return True
        s["hull"], s["new"] = _hull([*s["hull"], *s["new"]]), []
        return box_diagonal(s["hull"]) < max_diameter_m

    def start() -> dict:
        return {"points": deque(), "hull": [], "new": [], "stopped": False}

    def step(pid, s, point) -> list[tuple]:
        w, out = s["points"], []
        w.append(point)
        cut = False
        while not s["stopped"] and len(w) > 2 and (w[-1][0] - w[0][0]).total_seconds() >= min_duration_s:
            w.popleft()
            cut = True
        lat0 = w[0][1]
        if cut or len(w) <= 2:  # while nothing is cut, the box and the hull grow by the point
            s["hull"], s["new"] = [], [_planar(*p[1:], lat0) for p in w]
            x, y = zip(*s["new"], strict=True)
            s["box"] = (min(x), max(x), min(y), max(y))
        else:
            x, y = _planar(*point[1:], lat0)
            s["new"].append((x, y))
            x0, x1, y0, y1 = s["box"]
            s["box"] = (min(x0, x), max(x1, x), min(y0, y), max(y1, y))
        now = len(w) > 1 and within(s)
        if s["stopped"] and not now and len(w) > 1 and (w[-2][0] - w[0][0]).total_seconds() >= min_duration_s:
            out = [_stop(pid, list(w)[:-1], w[-2][0])]
            w.clear()
            s["hull"], s["new"] = [], []
        s["stopped"] = now
        return out

    def finish(pid, s) -> list[tuple]:
        w = s["points"]
        return [_stop(pid, list(w), w[-1][0])] if s["stopped"] and (w[-1][0] - w[0][0]).total_seconds() >= min_duration_s else []

    return _streamed(points, start, step, finish)


def stops_anchor(points: DataFrame, min_time_s: float = 300.0, radius_m: float = 100.0, chunk: int = CHUNK) -> DataFrame:
    """Stays within ``radius_m`` of their first point for more than ``min_time_s``.

    A stay ends when a point leaves the radius, which is its end time and the next anchor;
    the place is the median of the points before. A stay still open at the end isn't given.
    Anchors are the references of a chain (see chain), so a long track is cut into chunks.
    """

    def reached(ref, box) -> bool:
        """Whether a box lies within the radius: its farthest place is no farther than the sides from the anchor together."""
        lat0, lat1, lon0, lon1 = box
        north = max(abs(lat0 - ref[2]), abs(lat1 - ref[2]))
        east = max(abs(lon0 - ref[3]), abs(lon1 - ref[3]))
        return (north + east) * _DEGREE_M * 1.001 <= radius_m

    own = durable(follow(points, lambda ref, ts, lat, lon: haversine(*ref[2:], lat, lon) > radius_m, reached, chunk), "anchors")
    stayed = own.select("participant_id", F.col("ref_at").alias("anchor"), "lat", "lon", "ts", F.lit(None).cast("timestamp_ntz").alias("left"))
    nothing = F.lit(None).cast("double")
    left = own.where("is_ref and before_at is not null").select("participant_id", F.col("before_at").alias("anchor"), nothing.alias("lat"), nothing.alias("lon"), F.lit(None).cast("timestamp_ntz").alias("ts"), F.col("ts").alias("left"))
    stays = stayed.unionByName(left).groupBy("participant_id", "anchor").agg(F.min("ts").alias("start_time"), F.max("left").alias("end_time"), F.median("lat").alias("lat"), F.median("lon").alias("lon"))
    long = stays.withColumn("duration_s", (micros(F.col("end_time")) - micros(F.col("start_time"))) / 1_000_000)
    return long.where(F.col("duration_s") > min_time_s).select("participant_id", "start_time", "end_time", "duration_s", "lat", "lon")
