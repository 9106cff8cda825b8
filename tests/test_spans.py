"""Windows over spans of a track against windows over the whole track."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wayspark.operators import moves, points, report
from wayspark.operators.spans import in_spans, running_sum

POINTS = "participant_id long, event_id long, ts timestamp_ntz, lat double, lon double"
START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def tracks(spark):
    """One long track with dense and empty days, two short ones and one of unknown owner; equal times and null times."""
    rng, rows, at = random.Random(5), [], START
    for i in range(600):
        at += timedelta(seconds=rng.choice((0, 5, 60, 600, 4000, 90_000, 400_000) if i % 40 < 8 else (0, 5, 60, 600)))
        rows.append((1, i, at, 48.8 + rng.random() / 50, 2.3 + rng.random() / 50))
    rows += [(2, 1000, START, 48.8, 2.3), (3, 1001, START, 48.8, 2.3), (3, 1002, START + timedelta(days=9), 48.9, 2.3)]
    rows += [(None, 1100 + i, START + timedelta(hours=11 * i), 48.8 + i / 100, 2.3) for i in range(5)]
    rows += [(1, 1200, None, 48.8, 2.3), (1, 1201, None, 48.9, 2.4), (1, 1202, START + timedelta(seconds=7), None, None)]
    return spark.createDataFrame(rows, POINTS).repartition(4).cache()


def table(df, *columns):
    return sorted((tuple(None if v is None else round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*(columns or df.columns)).collect()), key=str)


@pytest.mark.parametrize("seconds", [60, 3600, 86_400, 10**9])
def test_windows_do_not_depend_on_spans(tracks, seconds):
    both = (
        (points.with_steps(tracks), points.steps_in_spans(tracks, seconds), ("event_id", "time_diff_s", "dist_m", "speed_kmh")),
        (points.prepared(tracks), points.prepared_in_spans(tracks, seconds=seconds), ("event_id", "speed_kmh_smooth")),
        (moves.move_sessions(tracks), moves.move_sessions_in_spans(tracks, span_s=seconds), ("event_id", "move_id")),
    )
    for plain, cut, columns in both:
        assert cut.columns == plain.columns
        assert table(cut, *columns) == table(plain, *columns)


@pytest.mark.parametrize("before, after", [(0, 0), (4, 3), (0, 7)])
def test_halos_over_several_spans(tracks, before, after):
    some = tracks.where("participant_id = 1 and ts is not null")
    near = lambda rows, w: rows.withColumn("near", F.collect_list("event_id").over(w.rowsBetween(-before, after)))
    assert table(in_spans(some, near, before, after, seconds=300), "event_id", "near") == table(near(some, points.by_time()), "event_id", "near")


def test_sums_of_nulls(tracks):
    rows = tracks.withColumn("v", F.when(F.col("event_id") % 3 == 0, F.col("event_id")))
    whole = rows.withColumn("s", F.sum("v").over(points.by_time().rowsBetween(W.unboundedPreceding, 0)))
    assert table(running_sum(rows, "v", "s", seconds=3600), "event_id", "s") == table(whole, "event_id", "s")


def test_rows_are_exchanged_by_span(tracks):
    plan = points.prepared_in_spans(tracks)._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda line: re.search(r"[A-Z]", line).start()
    by_one = [i for i, x in enumerate(plan) if re.search(r"Exchange hashpartitioning\(participant_id#\d+L, \d+\)", x)]
    assert by_one and sum("hashpartitioning(participant_id" in x and "_span" in x for x in plan) >= 2
    for i in by_one:  # by participant alone goes only what a group limit has left
        below = []
        for x in plan[i + 1:]:
            if not x.strip() or depth(x) <= depth(plan[i]):
                break
            below.append(x)
        assert any("WindowGroupLimit" in x for x in below)


def brute_minutes(rows):
    """{(participant, minute): speed} of (participant, ts, speed)."""
    out = {}
    for one in {r[0] for r in rows}:
        held = {}
        for _, ts, v in (r for r in rows if r[0] == one):
            held.setdefault(ts.replace(second=0, microsecond=0), []).append(v)
        mean = {m: sum(x for x in v if x is not None) / sum(x is not None for x in v) for m, v in held.items() if any(x is not None for x in v)}
        m = min(held)
        while m <= max(held):
            p, n = max((k for k in mean if k <= m), default=None), min((k for k in mean if k >= m), default=None)
            if p is None:
                out[one, m] = None
            elif n is None or p == n:
                out[one, m] = mean[p]
            else:
                out[one, m] = mean[p] + (mean[n] - mean[p]) * ((m - p) / (n - p))
            m += timedelta(minutes=1)
    return out


@pytest.mark.parametrize("span", [600, 86_400])
def test_minutes(spark, span):
    rng, rows = random.Random(2), []
    for one in range(4):
        at = START
        for i in range(60):
            at += timedelta(seconds=rng.choice((3, 30, 61, 500, 9000)))
            rows.append((one, at, None if i < 2 or i > 57 or rng.random() < 0.2 else rng.random() * 100))
    rows += [(7, START, None), (7, START + timedelta(minutes=3), None), (8, START, 4.0)]
    steps = spark.createDataFrame(rows, "participant_id long, ts timestamp_ntz, speed_kmh double")
    got = report.speed_per_minute(steps, span)
    want = brute_minutes(rows)
    assert table(got) == sorted(((*k, v if v is None else round(v, 6)) for k, v in want.items()), key=str)
    rolled = {(r.participant_id, r.minute): r.rolling_kmh for r in report.rolling_speed(got, 10, span).collect()}
    for (one, m), v in rolled.items():
        near = [want.get((one, m + timedelta(minutes=k))) for k in range(-5, 5)]
        near = [x for x in near if x is not None]
        assert v is None if not near else v == pytest.approx(sum(near) / len(near))


def test_nothing(spark):
    none = spark.createDataFrame([], POINTS)
    assert points.prepared_in_spans(none).count() == moves.move_sessions_in_spans(none).count() == 0
    assert report.rolling_speed(report.speed_per_minute(points.prepared_in_spans(none))).count() == 0


def test_types_of_minutes_by_runs(spark):
    """As the join of all minutes with the stops, for stops that overlap, touch and reach beyond the track."""
    rng = random.Random(5)
    t = datetime(2024, 1, 2)
    steps = [(p, t + timedelta(seconds=rng.randrange(90_000)), 1.0 * k) for p in range(3) for k in range(30)]
    stops = [(p, k, rng.choice(["Home", "Work", "autre", None]), a := t + timedelta(seconds=rng.randrange(-5000, 95_000)), a + timedelta(seconds=rng.choice([0, 20, 60, 600, 9000]))) for p in range(2) for k in range(40)]
    at = spark.createDataFrame(steps, "participant_id long, ts timestamp_ntz, speed_kmh double")
    of = spark.createDataFrame(stops, "participant_id long, stop_seq long, place_type string, start_time timestamp_ntz, end_time timestamp_ntz")
    want = sorted(map(tuple, report.with_place_type(report.speed_per_minute(at), of).select("participant_id", "minute", "place_type").collect()))
    for bucket in (360, 7):
        found = report.minute_place_types(at, of, bucket=bucket)
        assert sorted(map(tuple, found.collect())) == want and len({w[2] for w in want}) == 4
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("Exchange") > plan.index("explode(sequence(f")  # no exchange above the minutes


def test_rolling_means_without_an_exchange_of_minutes(spark):
    """As windows over all minutes, for tracks with gaps of all lengths, without values at either end or anywhere."""
    rng = random.Random(6)
    rows = [(4, START, None), (4, START + timedelta(minutes=3), None), (5, START, 7.0)]
    for p in range(4):
        at = START
        for k in range(60):
            at += timedelta(minutes=rng.choice([1, 1, 1, 2, 4, 9, 10, 11, 30]))
            empty = (p == 1 and k < 3) or (p == 2 and k > 55) or (p == 3 and (k < 20 or k > 40))
            rows.append((p, at, None if empty else rng.uniform(0, 50)))
    steps = spark.createDataFrame(rows, "participant_id long, ts timestamp_ntz, speed_kmh double")
    for minutes in (10, 5):
        want = {(r.participant_id, r.minute): r.rolling_kmh for r in report.rolling_speed(report.speed_per_minute(steps), minutes).collect()}
        found = report.rolling_speed_of(steps, minutes, 3600)
        got = {(r.participant_id, r.minute): r.rolling_kmh for r in found.collect()}
        assert got.keys() == want.keys() and found.count() == len(got)
        assert all((got[k] is None) == (v is None) and (v is None or got[k] == pytest.approx(v, rel=1e-12)) for k, v in want.items())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert all("Repartition" not in line and "Window" not in line for line in plan.splitlines()[: next(i for i, line in enumerate(plan.splitlines()) if "Generate" in line)])
