"""Shapefiles written and read back."""

import datetime
import os
import struct

import pytest

from wayspark.sources import shapefile

ROWS = [
    ("POINT (1.5 -2.25)", 1, "a", 0.1, True, datetime.date(2024, 2, 29)),
    ("MULTIPOINT (0.0 0.0, 1.0 1.0)", 2, "é ß", -1e-300, False, None),
    ("LINESTRING (0.0 0.0, 1.0 1.0, 2.0 0.5)", 3, None, None, None, None),
    ("MULTILINESTRING ((0.0 0.0, 1.0 1.0), (5.0 5.0, 6.0 6.0, 7.0 5.0))", 4, "x" * 254, 1e300, True, None),
    ("POLYGON ((0.0 0.0, 0.0 9.0, 9.0 9.0, 9.0 0.0, 0.0 0.0), (1.0 1.0, 2.0 1.0, 2.0 2.0, 1.0 1.0))", 5, "hole", 5.0, False, None),
    ("MULTIPOLYGON (((0.0 0.0, 0.0 1.0, 1.0 1.0, 0.0 0.0)), ((5.0 5.0, 5.0 8.0, 8.0 8.0, 5.0 5.0), (5.5 6.5, 6.0 7.0, 5.5 7.0, 5.5 6.5)))", 6, "two", 6.0, None, None),
    (None, 7, "null shape", 7.0, True, None),
]
SCHEMA = "wkt string, n long, name string, x double, ok boolean, day date"


@pytest.fixture
def spark_(spark):
    shapefile.register(spark)
    return spark


def test_round_trip_in_splits(spark_, tmp_path):
    path = str(tmp_path / "out")
    df = spark_.createDataFrame(ROWS * 5, SCHEMA).repartition(3)
    df.write.format("shapefile").mode("append").save(path)
    back = spark_.read.format("shapefile").option("records", 2).load(path)
    assert dict(back.dtypes) == {"wkt": "string", "n": "bigint", "name": "string", "x": "double", "ok": "boolean", "day": "date"}
    assert back.rdd.getNumPartitions() > len(shapefile.shapefiles(path))
    got = sorted(map(tuple, back.select(*df.columns).collect()), key=repr)
    assert got == sorted(ROWS * 5, key=repr)
    assert not [f for f in os.listdir(path) if f.startswith(".")]
    df.limit(7).write.format("shapefile").mode("overwrite").save(path)
    assert spark_.read.format("shapefile").load(path).count() == 7


def test_headers_and_a_file_without_index(spark_, tmp_path):
    path = str(tmp_path / "out")
    spark_.createDataFrame([("POINT (1 2)", 1), ("POINT (3 -4)", 2)], "wkt string, n int").coalesce(1).write.format("shapefile").mode("append").save(path)
    (shp,) = shapefile.shapefiles(path)
    raw = open(shp, "rb").read()
    assert struct.unpack(">i", raw[:4])[0] == 9994 and struct.unpack(">i", raw[24:28])[0] * 2 == len(raw)
    assert struct.unpack("<2i4d", raw[28:68]) == (1000, 1, 1.0, -4.0, 3.0, 2.0)
    os.remove(shp[:-4] + ".shx")
    got = spark_.read.format("shapefile").load(shp)
    assert got.rdd.getNumPartitions() == 1 and sorted(map(tuple, got.collect())) == [("POINT (1.0 2.0)", 1), ("POINT (3.0 -4.0)", 2)]


def test_rings_are_turned_and_odd_geometries(spark_, tmp_path):
    anticlockwise = "POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (1 1, 1 2, 2 2, 1 1))"
    kind, rings = shapefile.from_wkt(anticlockwise)
    assert kind == shapefile.POLYGON and shapefile.signed_area(rings[0]) < 0 < shapefile.signed_area(rings[1])
    for wkt in (None, "", "POLYGON EMPTY"):
        assert shapefile.from_wkt(wkt) == (shapefile.NULL, [])
    with pytest.raises(ValueError):
        shapefile.from_wkt("CIRCULARSTRING (0 0, 1 1)")
    bad = spark_.createDataFrame([("POINT (0 0)", "x" * 255)], "wkt string, t string")
    path = str(tmp_path / "bad")
    with pytest.raises(Exception, match="255 bytes"):
        bad.write.format("shapefile").mode("append").save(path)
    assert spark_.read.format("shapefile").load(path).count() == 0 and not os.listdir(path)
    none = spark_.createDataFrame([], "wkt string, n long")
    none.write.format("shapefile").mode("append").save(str(tmp_path / "none"))
    assert spark_.read.format("shapefile").load(str(tmp_path / "none")).count() == 0
