"""Reading GPS points and activities, and writing results."""

from __future__ import annotations

import html
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from wayspark.operators.points import in_box


def jdbc_options(env: dict[str, str] | None = None) -> dict[str, str]:
    """Options for Spark's JDBC source from PG_USER, PG_PASSWORD, PG_HOST, PG_PORT and PG_DB."""
    e = os.environ if env is None else env
    url = f"jdbc:postgresql://{e.get('PG_HOST', 'localhost')}:{e.get('PG_PORT', '5432')}/{e.get('PG_DB', '')}"
    return {"url": url, "user": e.get("PG_USER", ""), "password": e.get("PG_PASSWORD", "")}


def jdbc_ranges(spark: SparkSession, options: dict[str, str], table: str, column: str, parts: int, quote: str = '"') -> list[str]:
    """Conditions on a numeric or time ``column`` that part a database table into ``parts`` of about equal rows, and one for its nulls.

    The bounds are quantiles, so a hot stretch of values doesn't become one task. They come
    from the column alone, read in stretches of equal width between its least and largest value.
    """
    name = f"{quote}{column}{quote}"
    read = lambda **more: spark.read.format("jdbc").options(**options, **more)
    lowest = read(query=f"select min({name}) as lo, max({name}) as hi from {table}").load()
    lo, hi = lowest.first()
    if lo is None:
        return []
    one = f"(select {name} from {table}) t"
    values = read(dbtable=one, partitionColumn=column, lowerBound=str(lo), upperBound=str(hi), numPartitions=str(parts)).load() if lo != hi and parts > 1 else read(dbtable=one).load()
    kind = values.schema[column].dataType
    timed = isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType))
    at = F.unix_micros(F.col(f"`{column}`").cast("timestamp")) if timed else F.col(f"`{column}`")
    cuts = values.agg(F.percentile_approx(at, [k / parts for k in range(1, parts)], 10_000)).first()[0] if parts > 1 else []
    cuts = sorted(set(cuts or []))
    if timed:
        texts = spark.createDataFrame([(int(c),) for c in cuts], "c long").select(F.timestamp_micros("c").cast("string")).collect() if cuts else []
        cuts = [f"timestamp('{r[0] if '.' in r[0] else r[0] + '.0'}')" for r in texts]
    bounds = [None, *cuts, None]
    between = [" and ".join([*([f"{name} >= {a}"] if a is not None else []), *([f"{name} < {b}"] if b is not None else [])]) or f"{name} is not null" for a, b in zip(bounds, bounds[1:])]
    return [*between, f"{name} is null"]


def points_from_jdbc(spark: SparkSession, table: str = "gps_all_participants", env: dict[str, str] | None = None, column: str = "participant_id", parts: int | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """Points of a database table, one task for each of ``parts`` ranges of ``column`` (see jdbc_ranges).

    Filters and columns are pushed down to the database. By default there are as many parts as
    the session has shuffle partitions; ``options`` stand for those of the environment.
    """
    given = jdbc_options(env) if options is None else options
    ranges = jdbc_ranges(spark, given, table, column, parts or int(spark.conf.get("spark.sql.shuffle.partitions")))
    properties = {k: v for k, v in given.items() if k != "url"}
    return spark.read.jdbc(given["url"], table, predicates=ranges or ["1 = 1"], properties=properties)


def participants(points: DataFrame) -> DataFrame:
    return points.select("participant_id").distinct()


def points_of(points: DataFrame, participant_id: int) -> DataFrame:
    return points.where(F.col("participant_id") == participant_id)


def activities_of(events: DataFrame, participant_id: int, ts: str = "Date de début", activity: str = "Position") -> DataFrame:
    """timestamp and activity of one participant, in order."""
    return events.where(F.col("participant_id") == participant_id).select(F.col(ts).alias("timestamp"), F.col(activity).alias("activity")).orderBy("timestamp", "activity")


def read_plt(spark: SparkSession, path: str, lat: tuple[float, float] = (22.14, 51.52), lon: tuple[float, float] = (114.0, 120.0)) -> DataFrame:
    """lat, lon, ts and file of .plt files; lines without seven fields, a date and a time (the headers) go.

    Only points strictly inside the box are kept.
    """
    f = F.split("value", ",")
    rows = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file")).where(F.col("value").rlike(r"^(?:[^,]*,){5}\d{4}-\d{2}-\d{2},\d{2}:\d{2}:\d{2}\s*$"))
    parsed = rows.select(
        f[0].try_cast("double").alias("lat"), f[1].try_cast("double").alias("lon"),
        F.try_to_timestamp(F.concat_ws(" ", f[5], F.trim(f[6])), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz").alias("ts"), "file",
    )
    return in_box(parsed, lat, lon)


PLT_HEADER = ("Geolife trajectory", "WGS 84", "Altitude is in Feet", "Reserved 3", "0,2,255,My Track,0,0,2,8421376", "0")


def write_plt(points: DataFrame, path: str) -> None:
    """Points (lat, lon, ts) as .plt text, each file with the six header lines first."""
    line = F.concat_ws(",", F.col("lat").cast("string"), F.col("lon").cast("string"), F.lit("0"), F.lit("0"), F.lit("0"), F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss"))
    spark = points.sparkSession
    head = spark.createDataFrame([(h,) for h in PLT_HEADER], "value string").coalesce(1)
    head.unionByName(points.select(line.alias("value"))).write.text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, one folder for each participant."""
    df.write.option("header", True).partitionBy("participant_id").csv(path)


def write_wkt(points: DataFrame, path: str, by: str | None = None) -> None:
    """Points (x, y) as WKT in CSV: one POINT a row, or one MULTIPOINT for each value of ``by``."""
    xy = F.concat_ws(" ", F.col("x").cast("string"), F.col("y").cast("string"))
    if by is None:
        out = points.withColumn("wkt", F.concat(F.lit("POINT ("), xy, F.lit(")")))
    else:
        rows = points.groupBy(by).agg(F.sort_array(F.collect_list(xy)).alias("_p"), F.count("*").alias("n"))
        out = rows.select(by, "n", F.concat(F.lit("MULTIPOINT ("), F.array_join("_p", ", "), F.lit(")")).alias("wkt"))
    out.write.option("header", True).csv(path)


def line_wkt(traj: DataFrame) -> DataFrame:
    """traj_id and the LINESTRING of its points in order."""
    rows = traj.groupBy("traj_id").agg(F.sort_array(F.collect_list(F.struct("pos", "x", "y"))).alias("_p"))
    points = F.transform("_p", lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string")))
    return rows.select("traj_id", F.concat(F.lit("LINESTRING ("), F.array_join(points, ", "), F.lit(")")).alias("wkt"))


def write_edges(edges: DataFrame, sites: DataFrame, path: str) -> float:
    """Edges (source, target, length) as LINESTRINGs in CSV; their total length is returned."""
    end = lambda c: sites.select(F.col("site_id").alias(c), F.concat_ws(" ", F.col("x").cast("string"), F.col("y").cast("string")).alias(f"_{c}"))
    rows = edges.join(end("source"), "source").join(end("target"), "target")
    rows.select("source", "target", "length", F.concat(F.lit("LINESTRING ("), F.concat_ws(", ", "_source", "_target"), F.lit(")")).alias("wkt")).write.option("header", True).csv(path)
    return edges.agg(F.sum("length")).first()[0] or 0.0


def write_hulls(hulls: DataFrame, path: str) -> float:
    """Hulls (cluster_id, pos, x, y, perimeter) as POLYGONs in CSV; their mean perimeter is returned.

    A hull of one or two corners becomes a POINT or a LINESTRING.
    """
    rows = hulls.groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("pos", "x", "y"))).alias("_p"), F.first("perimeter").alias("perimeter"))
    xy = F.transform("_p", lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string")))
    n = F.size("_p")
    wkt = F.when(n == 1, F.concat(F.lit("POINT ("), xy[0], F.lit(")"))).when(n == 2, F.concat(F.lit("LINESTRING ("), F.array_join(xy, ", "), F.lit(")")))
    wkt = wkt.otherwise(F.concat(F.lit("POLYGON (("), F.array_join(F.concat(xy, F.slice(xy, 1, 1)), ", "), F.lit("))")))
    rows.select("cluster_id", "perimeter", wkt.alias("wkt")).write.option("header", True).csv(path)
    return rows.agg(F.avg("perimeter")).first()[0] or 0.0


def read_wkt(spark: SparkSession, path: str | dict[int, str], id_column: str = "myid") -> DataFrame:
    """k, myid, part, pos, x, y: one row for each place of the geometries (column ``wkt``) in CSV files.

    ``path`` is a folder, or a folder for each k (the size of clusters that the geometries
    are for), read together with k as a column (else null). Points, multipoints, lines and
    polygons, single or multiple, are read; ``part`` counts the rings or lines, ``pos`` their
    places, both from 0. A missing id is 0. Rows without a geometry go.
    """
    out = None
    for k, where in (path if isinstance(path, dict) else {None: path}).items():
        rows = spark.read.option("header", True).option("escape", '"').csv(where)
        key = F.coalesce(F.trim(F.col(f"`{id_column}`")), F.lit("0")) if id_column in rows.columns else F.lit("0")
        one = rows.select(F.lit(k).cast("int").alias("k"), key.alias("myid"), F.upper("wkt").alias("_w"))
        out = one if out is None else out.unionByName(one)
    number = r"[-+]?[0-9.]+(?:E[-+]?[0-9]+)?"
    rings = F.regexp_extract_all("_w", F.lit(r"([-+0-9.E][-+0-9.E, ]*)"), F.lit(1))
    # the places of a multipoint may be in brackets of their own
    whole = F.when(F.col("_w").rlike(r"^\s*MULTIPOINT"), F.array(F.array_join(rings, ","))).otherwise(rings)
    parts = out.withColumn("_r", F.filter(whole, lambda r: r.rlike(number + " +" + number))).select("k", "myid", F.posexplode("_r").alias("part", "_r"))
    places = parts.select("k", "myid", "part", F.posexplode(F.split(F.trim("_r"), r"\s*,\s*")).alias("pos", "_p"))
    xy = F.split(F.trim("_p"), r"\s+")
    return places.select("k", "myid", "part", "pos", xy[0].try_cast("double").alias("x"), F.try_element_at(xy, F.lit(2)).try_cast("double").alias("y")).where("x is not null and y is not null")


def html_reports(tables: dict[str, DataFrame]) -> DataFrame:
    """participant_id, n and line: an HTML page for each participant with a whole table for each entry.

    A line is a row of a table, in the order of its columns, so no table is put together in
    memory; ``n`` orders the lines of a page.
    """
    who = None
    for df in tables.values():
        own = df.select("participant_id")
        who = own if who is None else who.unionByName(own)
    who = who.distinct()
    line = lambda k, text: who.select("participant_id", F.array(F.lit(k)).alias("n"), F.lit(text).alias("line"))
    out = line(-1, "<!DOCTYPE html><html><body>").unionByName(line(3 * len(tables), "</body></html>"))
    for k, (title, df) in enumerate(tables.items()):
        columns = [c for c in df.columns if c != "participant_id"]
        esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        row = F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), esc(c), F.lit("</td>")) for c in columns), F.lit("</tr>"))
        order = W.partitionBy("participant_id").orderBy(*columns)
        rows = df.select("participant_id", F.array(F.lit(3 * k + 1), F.row_number().over(order)).alias("n"), row.alias("line"))
        head = f"<h2>{html.escape(title)}</h2><table><tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in columns) + "</tr>"
        out = out.unionByName(line(3 * k, head)).unionByName(rows).unionByName(line(3 * k + 2, "</table>"))
    return out


def write_html(tables: dict[str, DataFrame], path: str) -> None:
    """One page of text for each participant, in a folder of its own under ``path``."""
    pages = html_reports(tables).repartition("participant_id").sortWithinPartitions("participant_id", "n")
    pages.select("participant_id", "line").write.partitionBy("participant_id").option("lineSep", "\n").text(path)
