import os
from datetime import datetime

from pyspark.sql import functions as F

from wayspark.operators import privacy
from wayspark.sources import fixtures, gps
from wayspark.streaming.sessions import session_moves


def test_plt_headers_and_box(spark, tmp_path):
    text = "\n".join([*gps.PLT_HEADER, "39.9,116.3,0,492,39744.1,2008-10-23,02:53:04", "39.9,113.9,0,492,39744.1,2008-10-23,02:53:10", "bad,116.3,0,1,2,2008-10-23,02:53:11", ""])
    (tmp_path / "a.plt").write_text(text)
    got = gps.read_plt(spark, str(tmp_path)).collect()
    assert [(r.lat, r.lon, r.ts, r.file) for r in got] == [(39.9, 116.3, datetime(2008, 10, 23, 2, 53, 4), "a.plt")]


def test_jdbc_options_come_from_the_environment():
    o = gps.jdbc_options({"PG_USER": "u", "PG_PASSWORD": "p", "PG_HOST": "h", "PG_DB": "d"})
    assert o == {"url": "jdbc:postgresql://h:5432/d", "user": "u", "password": "p"}


def test_sinks(spark, sf, tmp_path):
    stops = fixtures.stops(spark, sf).where("stop_seq <= 3")
    gps.write_csv(stops, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == stops.count()
    gps.write_wkt(fixtures.sites(spark, sf), str(tmp_path / "wkt"), "cluster_id")
    assert all(r.wkt.startswith("MULTIPOINT (") for r in spark.read.option("header", True).csv(str(tmp_path / "wkt")).collect())
    gps.write_html({"Stops & more": stops.withColumn("note", F.lit("<b>")), "Points": fixtures.points(spark, sf)}, str(tmp_path / "html"))
    pages = [p.value for p in spark.read.text(str(tmp_path / "html"), wholetext=True).collect()]
    assert len(pages) == 4 and all("Stops &amp; more" in p and "&lt;b&gt;" in p for p in pages)
    assert sum(p.count("<tr><td>") for p in pages) == stops.count() + 1000  # whole tables
    assert all(p.startswith("<!DOCTYPE html>") and p.rstrip().endswith("</body></html>") and p.index("Stops &amp;") < p.index("Points") for p in pages)
    assert gps.line_wkt(fixtures.trajectories(spark, sf)).first().wkt.startswith("LINESTRING (")


def test_streaming_sessions_equal_batch_sessions(spark, sf, tmp_path):
    rows = fixtures.points(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    folder = str(tmp_path / "points")
    rows.write.parquet(folder)
    end = rows.limit(1).withColumn("ts", F.timestamp_seconds(F.lit(4_000_000_000))).withColumn("participant_id", F.lit(99).cast("long"))
    os.makedirs(folder, exist_ok=True)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = session_moves(stream).writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    end.write.mode("append").parquet(folder)
    q.processAllAvailable()
    q.processAllAvailable()
    q.stop()
    key = ["participant_id", "start_time", "end_time", "n_points"]
    got = {tuple(r) for r in spark.table("sessions").select(*key).collect()}
    want = {tuple(r) for r in session_moves(rows).select(*key).collect()}
    assert got and got <= want and len(want) - len(got) <= 1


def test_wkt_comes_back(spark, sf, tmp_path):
    sites = fixtures.sites(spark, sf)
    for k in (3, 4):
        gps.write_wkt(sites.where(f"site_id > {k}"), str(tmp_path / f"m{k}"), "cluster_id")
    got = gps.read_wkt(spark, {k: str(tmp_path / f"m{k}") for k in (3, 4)}, "cluster_id")
    want = {(k, str(r.cluster_id), r.x, r.y) for r in sites.collect() for k in (3, 4) if r.site_id > k}
    assert {(r.k, r.myid, r.x, r.y) for r in got.collect()} == want and got.count() == len(want)
    text = ['myid,wkt', '1,POINT (1 2)', '2,"LINESTRING (1 2, -3.5 4e1)"', '3,"POLYGON ((0 0, 1 0, 1 1, 0 0), (.2 .2, .4 .2, .4 .4, .2 .2))"', '4,"MULTIPOINT ((1 1), (2 2))"', '5,"multilinestring ((0 0, 1 1), (5 5, 6 6))"', ',POINT (9 9)', '7,', '8,"POINT EMPTY"']
    (tmp_path / "g.csv").write_text("\n".join(text))
    rows = {}
    for r in gps.read_wkt(spark, str(tmp_path / "g.csv")).orderBy("myid", "part", "pos").collect():
        rows.setdefault(r.myid, []).append((r.part, r.x, r.y))
    assert rows == {
        "0": [(0, 9, 9)], "1": [(0, 1, 2)], "2": [(0, 1, 2), (0, -3.5, 40)], "4": [(0, 1, 1), (0, 2, 2)], "5": [(0, 0, 0), (0, 1, 1), (1, 5, 5), (1, 6, 6)],
        "3": [(0, 0, 0), (0, 1, 0), (0, 1, 1), (0, 0, 0), (1, 0.2, 0.2), (1, 0.4, 0.2), (1, 0.4, 0.4), (1, 0.2, 0.2)],
    }


def test_edges_and_hulls_as_wkt(spark, tmp_path):
    sites = spark.createDataFrame([(1, 0.0, 0.0, 1), (2, 3.0, 4.0, 1), (3, 3.0, 0.0, 1), (4, 9.0, 9.0, 2)], "site_id long, x double, y double, cluster_id long")
    edges = spark.createDataFrame([(1, 2, 5.0), (2, 3, 4.0)], "source long, target long, length double")
    assert gps.write_edges(edges, sites, str(tmp_path / "e")) == 9
    assert sorted(r.wkt for r in spark.read.option("header", True).csv(str(tmp_path / "e")).collect()) == ["LINESTRING (0.0 0.0, 3.0 4.0)", "LINESTRING (3.0 4.0, 3.0 0.0)"]
    assert gps.write_hulls(privacy.cluster_hulls(sites), str(tmp_path / "h")) == 6
    assert {r.cluster_id: r.wkt.split()[0] for r in spark.read.option("header", True).csv(str(tmp_path / "h")).collect()} == {"1": "POLYGON", "2": "POINT"}
