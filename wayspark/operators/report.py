"""Tables behind the mobility report: summaries, histograms, resampled speed, styles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import WindowSpec

from wayspark.operators.joins import interval_pairs
from wayspark.operators.moves import seconds
from wayspark.operators.spans import SPAN_S, in_spans

WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
ONE = "participant_id"


def places_per_type(stops: DataFrame) -> DataFrame:
    return stops.groupBy(ONE, "place_type").agg(F.count("*").alias("n_places"))


def visits_describe(visits: DataFrame) -> DataFrame:
    """Count, mean, deviation, minimum, quartiles and maximum of visits by place (place_id), per type."""
    q = lambda p: F.percentile("visits", F.lit(p))
    return visits.groupBy(ONE, "place_id", "place_type").agg(F.count("*").alias("visits")).groupBy(ONE, "place_type").agg(
        F.count("*").alias("n"), F.avg("visits").alias("mean"), F.stddev_samp("visits").alias("std"), F.min("visits").cast("double").alias("min"),
        q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"), F.max("visits").cast("double").alias("max"),
    )


def visit_hours(visits: DataFrame) -> DataFrame:
    return visits.groupBy(ONE, "place_type", F.hour("start_time").alias("hour")).agg(F.count("*").alias("n_visits"))


def minutes_per_type(stops: DataFrame) -> DataFrame:
    return stops.groupBy(ONE, "place_type").agg((F.sum("duration_s") / 60).alias("minutes"))


def summary(steps: DataFrame, grouped: DataFrame) -> DataFrame:
    """One row per participant: points, stops, minutes stopped and moving, kilometres, dates."""
    points = steps.groupBy(ONE).agg(
        F.count("*").alias("n_points"), (F.sum("dist_m") / 1000).alias("total_km"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.count_distinct(F.to_date("ts")).alias("n_days"),
    )
    stops = grouped.groupBy(ONE).agg(F.count("*").alias("n_stops"), (F.sum("duration_s") / 60).alias("stop_min"))
    span = seconds(F.col("first_ts"), F.col("last_ts")) / 60
    return points.join(stops, ONE, "left").fillna(0, ["n_stops", "stop_min"]).withColumn("span_min", span).withColumn("move_min", F.col("span_min") - F.col("stop_min"))


def points_per_day(points: DataFrame) -> DataFrame:
    return points.groupBy(ONE, F.to_date("ts").alias("date")).agg(F.count("*").alias("n_points"))


def speed_stats(steps: DataFrame) -> DataFrame:
    return steps.groupBy(ONE).agg(
        F.avg("speed_kmh").alias("mean_speed"), F.max("speed_kmh").alias("max_speed"), F.floor(F.count("*") / F.count_distinct(F.to_date("ts"))).alias("points_per_day"),
        F.avg("time_diff_s").alias("mean_interval_s"),
    )


def speed_by_hour(steps: DataFrame) -> DataFrame:
    return steps.groupBy(ONE, F.hour("ts").alias("hour")).agg(F.avg("speed_kmh").alias("mean_speed"), F.count("speed_kmh").alias("n"))


def speed_by_weekday(steps: DataFrame) -> DataFrame:
    """All seven days from Monday for each participant; null where there is no data."""
    days = steps.select(ONE).distinct().withColumn("d", F.explode(F.array(*map(F.lit, range(7)))))
    means = steps.groupBy(ONE, F.weekday("ts").alias("d")).agg(F.avg("speed_kmh").alias("mean_speed"))
    name = F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.col("d") + 1)
    return days.join(means, [ONE, "d"], "left").select(ONE, F.col("d").alias("weekday_num"), name.alias("weekday"), "mean_speed")


def speed_by_daytype_hour(steps: DataFrame) -> DataFrame:
    return steps.groupBy(ONE, (F.weekday("ts") >= 5).alias("is_weekend"), F.to_date("ts").alias("date"), F.hour("ts").alias("hour")).agg(F.avg("speed_kmh").alias("mean_speed"))


def heat(steps: DataFrame, value: Column) -> DataFrame:
    """Date by hour of day, h0 to h23, one aggregate; 0 where there is no data."""
    cells = [F.coalesce(value_at(value, h), F.lit(0)).alias(f"h{h}") for h in range(24)]
    return steps.groupBy(ONE, F.to_date("ts").alias("date")).agg(*cells)


def value_at(value: Column, hour: int) -> Column:
    return F.avg(F.when(F.hour("ts") == hour, value))


def heat_counts(points: DataFrame) -> DataFrame:
    cells = [F.count(F.when(F.hour("ts") == h, 1)).alias(f"h{h}") for h in range(24)]
    return points.groupBy(ONE, F.to_date("ts").alias("date")).agg(*cells)


def histogram(steps: DataFrame, value: Column, bins: int, low: float | None = None, high: float | None = None, open_left: bool = False) -> DataFrame:
    """Counts in equal bins over the given range, or over the data's per participant.

    The last bin takes the upper end; ``open_left`` drops the lower end. Empty bins have no row.
    """
    rows = steps.select(ONE, value.alias("v")).where("v is not null")
    if low is None:
        range_ = rows.groupBy(ONE).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
        rows = rows.join(range_, ONE)
    else:
        rows = rows.withColumns({"lo": F.lit(low), "hi": F.lit(high)}).where((F.col("v") > low if open_left else F.col("v") >= low) & (F.col("v") <= high))
    width = (F.col("hi") - F.col("lo")) / bins
    number = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1)))
    return rows.groupBy(ONE, number.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def speed_per_minute(steps: DataFrame, span_s: int = SPAN_S) -> DataFrame:
    """Mean speed of every minute from first to last; gaps are filled in between linearly.

    Minutes before the first value stay null, those after the last repeat it. Only minutes
    with a value are put in order, by spans of the track; each brings forth those up to the next.
    """
    minute = F.date_trunc("minute", F.col("ts")).cast("timestamp_ntz")
    means = steps.groupBy(ONE, minute.alias("minute")).agg(F.avg("speed_kmh").alias("mean"))
    known = means.where("mean is not null")
    following = lambda rows, w: rows.withColumn("next", F.lead(F.struct("minute", "mean")).over(w))
    pairs = in_spans(known, following, after=1, order=("minute",), seconds=span_s).where("next is not null")
    step, to = F.expr("interval 1 minute"), F.col("next.minute")
    part = F.try_divide(seconds(F.col("minute"), F.col("at")), seconds(F.col("minute"), to))
    between = pairs.select("*", F.explode(F.sequence(F.col("minute"), to - step, step)).alias("at")).select(ONE, F.col("at").alias("minute"), (F.col("mean") + (F.col("next.mean") - F.col("mean")) * part).alias("speed_kmh"))
    has = F.when(F.col("mean").isNotNull(), F.col("minute"))
    track = means.groupBy(ONE).agg(F.min("minute").alias("a"), F.max("minute").alias("b"), F.min(has).alias("first"), F.max(has).alias("last"), F.max_by("mean", has).alias("mean"))
    head = track.where("first is null or a < first").select(ONE, F.explode(F.sequence(F.col("a"), F.coalesce(F.col("first") - step, F.col("b")), step)).alias("minute"), F.lit(None).cast("double").alias("speed_kmh"))
    tail = track.where("last is not null").select(ONE, F.explode(F.sequence(F.col("last"), F.col("b"), step)).alias("minute"), F.col("mean").alias("speed_kmh"))
    return between.unionByName(head).unionByName(tail)


def rolling_speed(per_minute: DataFrame, minutes: int = 10, span_s: int = SPAN_S) -> DataFrame:
    """Centred mean; an even window reaches one row further back than ahead."""
    back, ahead = minutes // 2, (minutes - 1) // 2
    mean = lambda rows, w: rows.withColumn("rolling_kmh", F.avg("speed_kmh").over(w.rowsBetween(-back, ahead)))
    return in_spans(per_minute, mean, back, ahead, ("minute",), span_s)


def with_place_type(per_minute: DataFrame, stops: DataFrame, moving: str = "Move") -> DataFrame:
    """Adds the type of the first stop (by stop_seq) that contains the minute."""
    spans = stops.select(ONE, "stop_seq", "place_type", "start_time", "end_time")
    found = interval_pairs(per_minute.select(ONE, "minute"), spans, ONE, "minute", "start_time", "end_time").groupBy(ONE, "minute").agg(F.min_by("place_type", "stop_seq").alias("place_type"))
    return per_minute.join(found, [ONE, "minute"], "left").fillna(moving, ["place_type"])


def rolling_speed_of(steps: DataFrame, minutes: int = 10, span_s: int = SPAN_S) -> DataFrame:
    """:func:`rolling_speed` of :func:`speed_per_minute`, without an exchange of minutes.

    Minutes with a value are put in order, each with the lines between the few around it that
    a window may reach; it brings forth the means of the minutes up to the next. Windows on
    one line add up its values, those over several look for theirs.
    """
    back, ahead = minutes // 2, (minutes - 1) // 2
    means = steps.groupBy(ONE, F.date_trunc("minute", F.col("ts")).cast("timestamp_ntz").alias("minute")).agg(F.avg("speed_kmh").alias("mean"))
    has = F.when(F.col("mean").isNotNull(), F.col("minute"))
    track = means.groupBy(ONE).agg(F.min("minute").alias("a"), F.max("minute").alias("b"), F.min(has).alias("first"), F.max(has).alias("last"), F.max_by("mean", has).alias("mean"))
    # the last value stays as far as the track goes
    known = means.where("mean is not null").unionByName(track.where("b > last").select(ONE, F.col("b").alias("minute"), "mean"))
    apart = lambda a, b: (seconds(a, b) / 60).cast("long")

    def around(rows: DataFrame, w: WindowSpec) -> DataFrame:
        at = F.struct("minute", "mean")
        near = [F.lag(at, k).over(w) for k in range(back, 0, -1)] + [at] + [F.lead(at, k).over(w) for k in range(1, ahead + 2)]
        dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), ONE, "_span")  # few bytes but much work
        return dealt.withColumns({"_near": F.array(*near), "next": F.lead(at).over(w), "_begins": F.lag("minute").over(w).isNull()})

    lines = in_spans(known, around, back, ahead + 1, ("minute",), span_s).withColumn("_to", apart(F.col("minute"), F.col("next.minute")))
    part = lambda k: F.col("mean") + (F.col("next.mean") - F.col("mean")) * ((F.col("d") + k) / F.col("_to"))
    inner = lines.where(F.col("_to") > back + ahead).select(ONE, "minute", "mean", "next", "_to", F.explode(F.sequence(F.lit(back).cast("long"), F.col("_to") - ahead - 1)).alias("d"))
    total = part(-back)
    for k in range(1 - back, ahead + 1):
        total = total + part(k)
    found = inner.select(ONE, "minute", "d", (total / minutes).alias("rolling_kmh"))

    # lines as (lo, hi, value at lo, value at hi), minutes counted from this one; the last place is one of itself
    knots = F.transform(F.filter("_near", lambda r: r.isNotNull()), lambda r: F.struct(apart(F.col("minute"), r["minute"]).alias("t"), r["mean"].alias("v")))
    span = lambda r, i: F.struct(r["t"].alias("lo"), F.coalesce(F.try_element_at("_knots", i + 2)["t"], r["t"] + 1).alias("hi"), r["v"].alias("v"), F.coalesce(F.try_element_at("_knots", i + 2)["v"], r["v"]).alias("to"))
    long = F.coalesce("_to", F.lit(1).cast("long"))
    some = lambda low, high: F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    whole = lambda n: F.lit(n).cast("long")
    edges = F.concat(some(whole(0), F.least(whole(back), long) - 1), some(F.greatest(whole(back), long - ahead), long - 1))
    begun = lines.where("_begins").join(track.select(ONE, "a"), ONE).withColumn("_ds", some(F.greatest(apart(F.col("minute"), F.col("a")), whole(-ahead)), whole(-1)))
    near = lines.withColumn("_ds", edges).select(ONE, "minute", "_near", "_ds").unionByName(begun.select(ONE, "minute", "_near", "_ds"))
    near = near.withColumn("_knots", knots).withColumn("_lines", F.transform("_knots", span)).select(ONE, "minute", "_lines", F.explode("_ds").alias("d"))

    def value(k: Column) -> Column:
        on = F.filter("_lines", lambda r: (r["lo"] <= F.col("d") + k) & (F.col("d") + k < r["hi"]))
        return F.try_element_at(F.transform(on, lambda r: r["v"] + (r["to"] - r["v"]) * ((F.col("d") + k - r["lo"]) / (r["hi"] - r["lo"]))), F.lit(1))

    values = F.transform(F.array(*map(whole, range(-back, ahead + 1))), value)
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))
    mean = F.aggregate(values, start, lambda a, v: F.struct((a["sum"] + F.coalesce(v, F.lit(0.0))).alias("sum"), (a["n"] + F.when(v.isNotNull(), 1).otherwise(0)).alias("n")), lambda a: F.try_divide(a["sum"], a["n"]))
    found = found.unionByName(near.select(ONE, "minute", "d", mean.alias("rolling_kmh")))
    at = F.col("minute") + F.make_dt_interval(mins=F.col("d").cast("int"))
    step = F.expr("interval 1 minute")
    reach = F.coalesce(F.col("first") - F.expr(f"interval {ahead + 1} minute"), F.col("b"))
    head = track.where(F.col("a") <= reach).select(ONE, F.explode(F.sequence(F.col("a"), reach, step)).alias("minute"), F.lit(None).cast("double").alias("rolling_kmh"))
    return found.select(ONE, at.alias("minute"), "rolling_kmh").unionByName(head)


def minute_place_types(steps: DataFrame, stops: DataFrame, moving: str = "Move", bucket: int = 360) -> DataFrame:
    """participant_id, minute and place_type: :func:`with_place_type` of all minutes from a track's first to its last.

    Stops and tracks are cut into buckets of minutes, a bucket into runs of one type, and only
    then into minutes, so these are never exchanged.
    """
    number = lambda ts, f=F.floor: f(F.unix_micros(ts.cast("timestamp")) / 60_000_000).cast("long")
    buckets = lambda a, b: F.sequence(F.floor(a / bucket), F.floor(b / bucket))
    low, high = F.col("_b") * bucket, (F.col("_b") + 1) * bucket - 1
    minute = F.date_trunc("minute", F.col("ts"))
    track = steps.groupBy(ONE).agg(number(F.min(minute)).alias("a"), number(F.max(minute)).alias("b")).where("a is not null")
    track = track.withColumn("_b", F.explode(buckets(F.col("a"), F.col("b"))))
    held = stops.select(ONE, "stop_seq", "place_type", number(F.col("start_time"), F.ceil).alias("f"), number(F.col("end_time")).alias("t")).where("f <= t")
    held = held.withColumn("_b", F.explode(buckets(F.col("f"), F.col("t"))))
    stop = F.struct("stop_seq", "place_type", F.greatest("f", low).alias("f"), F.least("t", high).alias("t"))
    rows = track.select(ONE, "_b", F.greatest("a", low).alias("_lo"), F.least("b", high).alias("_hi")).unionByName(held.select(ONE, "_b", stop.alias("_s")), allowMissingColumns=True)
    cut = rows.groupBy(ONE, "_b").agg(F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.collect_list("_s").alias("_in")).where("_lo is not null")
    begins = F.concat(F.array("_lo"), F.transform("_in", lambda s: s["f"]), F.transform("_in", lambda s: s["t"] + 1))
    cut = cut.withColumn("_at", F.array_sort(F.array_distinct(F.filter(begins, lambda c: (c >= F.col("_lo")) & (c <= F.col("_hi"))))))

    def run(c: Column, i: Column) -> Column:
        first = F.array_min(F.transform(F.filter("_in", lambda s: (s["f"] <= c) & (c <= s["t"])), lambda s: F.struct(s["stop_seq"], s["place_type"].alias("place_type"))))
        return F.struct(c.alias("f"), F.coalesce(F.try_element_at("_at", i + 2) - 1, F.col("_hi")).alias("t"), F.coalesce(first["place_type"], F.lit(moving)).alias("place_type"))

    runs = cut.select(ONE, F.explode(F.transform("_at", run)).alias("_r")).select(ONE, "_r.*")
    each = runs.select(ONE, "place_type", F.explode(F.sequence("f", "t")).alias("_m"))
    return each.select(ONE, F.timestamp_micros(F.col("_m") * 60_000_000).cast("timestamp_ntz").alias("minute"), "place_type")


def move_totals(moves: DataFrame) -> DataFrame:
    return moves.groupBy(ONE).agg(F.sum("dist_m").alias("total_m"), F.count("*").alias("n_moves"), (F.sum("duration_s") / 60).alias("total_min"))


def segment_stats(steps: DataFrame, segments: DataFrame) -> DataFrame:
    """Points, kilometres and mean speed of each run of consecutive days."""
    days = segments.select(ONE, "first_date", "last_date", F.explode(F.sequence("first_date", "last_date")).alias("date"))
    return steps.withColumn("date", F.to_date("ts")).join(days, [ONE, "date"]).groupBy(ONE, "first_date", "last_date").agg(
        F.count("*").alias("n_points"), (F.sum("dist_m") / 1000).alias("total_km"), F.avg("speed_kmh").alias("mean_speed")
    )


def map_center(points: DataFrame) -> DataFrame:
    return points.groupBy(ONE).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count_distinct(F.to_date("ts")).alias("n_days"))


def marker_style(stops: DataFrame) -> DataFrame:
    """Radius from 3 to 10 by half the minutes, and a colour by length."""
    minutes = F.col("duration_s") / 60
    return stops.withColumn("radius", F.least(F.lit(10.0), F.greatest(F.lit(3.0), minutes / 2))).withColumn("color", F.when(minutes < 5, "green").when(minutes < 15, "orange").otherwise("red"))


def stops_per_day(stops: DataFrame) -> DataFrame:
    return stops.groupBy(ONE, F.to_date("start_time").alias("date")).agg(F.count("*").alias("n_stops"))
