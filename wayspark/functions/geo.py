"""Distances, projections and grid keys as Column expressions (degrees in, metres out)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
EARTH_RADIUS_M = 6371008.8


def _central_angle(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine angle of points in radians."""
    a = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    return 2 * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere of radius EARTH_RADIUS_M."""
    return F.lit(EARTH_RADIUS_M) * _central_angle(*map(F.radians, (lat1, lon1, lat2, lon2)))


def geodesic_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """WGS-84 distance by Lambert's formula on reduced latitudes; 0 for equal points."""
    b1, b2 = (F.atan((1 - WGS84_F) * F.tan(F.radians(x))) for x in (lat1, lat2))
    s = _central_angle(b1, F.radians(lon1), b2, F.radians(lon2))
    p, q = (b1 + b2) / 2, (b2 - b1) / 2
    x = (s - F.sin(s)) * F.pow(F.sin(p) * F.cos(q) / F.cos(s / 2), 2)
    y = (s + F.sin(s)) * F.pow(F.cos(p) * F.sin(q) / F.sin(s / 2), 2)
    return F.when(s == 0, F.lit(0.0)).otherwise(WGS84_A * (s - WGS84_F / 2 * (x + y)))


@F.pandas_udf(T.DoubleType())
def settled_geodesic_m(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    """:func:`geodesic_m` with the C library's functions, whose last bits differ from Java's: for the order of places as near as rounding."""

    def one(a: float, b: float, c: float, d: float) -> float:
        b1, b2 = (math.atan((1 - WGS84_F) * math.tan(math.radians(x))) for x in (a, c))
        turn = math.radians(d) - math.radians(b)
        s = 2 * math.asin(math.sqrt(min(1.0, math.sin((b2 - b1) / 2) ** 2 + math.cos(b1) * math.cos(b2) * math.sin(turn / 2) ** 2)))
        if s == 0:
            return 0.0
        x = (s - math.sin(s)) * (math.sin((b1 + b2) / 2) * math.cos((b2 - b1) / 2) / math.cos(s / 2)) ** 2
        y = (s + math.sin(s)) * (math.cos((b1 + b2) / 2) * math.sin((b2 - b1) / 2) / math.sin(s / 2)) ** 2
        return WGS84_A * (s - WGS84_F / 2 * (x + y))

    return pd.Series([one(*row) for row in zip(lat1, lon1, lat2, lon2, strict=True)], dtype="float64")


def mercator_x(lon: Column) -> Column:
    """Easting of EPSG:3857."""
    return WGS84_A * F.radians(lon)


def mercator_y(lat: Column) -> Column:
    """Northing of EPSG:3857."""
    return WGS84_A * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def planar_m(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt(F.pow(x2 - x1, 2) + F.pow(y2 - y1, 2))


def transverse_mercator(lat: Column, lon: Column, lon0: float, k0: float = 1.0, false_easting: float = 500_000.0, a: float = WGS84_A, f: float = WGS84_F) -> tuple[Column, Column]:
    """Easting and northing by the usual series in the distance from the meridian ``lon0``."""
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    phi = F.radians(lat)
    n = a / F.sqrt(1 - e2 * F.pow(F.sin(phi), 2))
    t, c = F.pow(F.tan(phi), 2), ep2 * F.pow(F.cos(phi), 2)
    d = F.radians(lon - lon0) * F.cos(phi)
    m = a * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi
        - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi)
        - (35 * e2**3 / 3072) * F.sin(6 * phi)
    )
    east = false_easting + k0 * n * (d + (1 - t + c) * F.pow(d, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * F.pow(d, 5) / 120)
    north = k0 * (m + n * F.tan(phi) * (F.pow(d, 2) / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(d, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * F.pow(d, 6) / 720))
    return east, north


def direction_deg(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Direction from the first to the second point, from 0 up to 360."""
    d = F.degrees(F.atan2(y2 - y1, x2 - x1))
    return F.when(d < 0, d + 360).otherwise(d)


def cell(value: Column, side: float | Column) -> Column:
    """Number of the grid cell that holds ``value``."""
    return F.floor(value / side).cast("long")


def around(index: Column) -> Column:
    """A cell and its neighbours along one axis."""
    return F.array(index - 1, index, index + 1)


#: Metres of a degree of latitude, at least and at most, on the sphere and the ellipsoid;
#: times the cosine of the latitude, the same of longitude.
LEAST_M, MOST_M = math.radians(1) * WGS84_A * (1 - WGS84_F) ** 2, math.radians(1) * WGS84_A / (1 - WGS84_F)


def _cos_of_row(row: Column, side: float, outer: bool) -> Column:
    """Cosine of the latitude at the outer or inner edge of a row of cells."""
    edge = (F.abs(row + 0.5) + (0.5 if outer else -0.5)) * side
    return F.greatest(F.cos(F.radians(F.least(edge, F.lit(90.0)))), F.lit(1e-3))


class Grid:
    """Cells in rows of latitude: no side is longer than ``metres`` / ``fine``.

    The width in degrees of longitude is that of the row, so cells are as good anywhere
    (beyond 89.9 degrees they get wider). Longitudes don't wrap at 180 degrees.
    """

    def __init__(self, metres: float, fine: float = 1.0):
        self.metres, self.side = metres, metres / fine / MOST_M
        self.reach = math.ceil(metres / LEAST_M / self.side * (1 + 1e-9))

    def width(self, row: Column) -> Column:
        return self.side / _cos_of_row(row, self.side, False)

    def of(self, lat: Column, lon: Column, scale: int = 1) -> tuple[Column, Column]:
        """Row and column of a place, in cells parted ``scale`` (a power of 2) times along both axes."""
        row = cell(lat, self.side)
        return F.floor(lat / self.side * scale).cast("long"), F.floor(lon / self.width(row) * scale).cast("long")

    def around(self, row: Column, west: Column, east: Column) -> Column:
        """Array of structs i, j: all cells that may hold places within ``metres`` of those in ``row`` from ``west`` to ``east``."""

        def of_row(k: Column) -> Column:
            far = self.metres / LEAST_M / F.least(_cos_of_row(row, self.side, True), _cos_of_row(k, self.side, True)) * (1 + 1e-9)
            return F.transform(F.sequence(cell(west - far, self.width(k)), cell(east + far, self.width(k))), lambda j: F.struct(k.alias("i"), j.alias("j")))

        return F.flatten(F.transform(F.sequence(row - self.reach, row + self.reach), of_row))
