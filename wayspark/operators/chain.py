"""Chains of reference points along a track, computed on chunks of it at once.

A point either becomes the new reference or is left to the one before (the anchor of a stay,
the last point kept). What a chunk does depends on the reference that it is entered with, so
chunks begin with a guess: their own first point, then what the chunk before ended with.
Chains that meet stay together, so nearly all guesses end as the truth would; only chunks
entered otherwise than supposed run again, in rounds, until none is left. The result is that
of one pass over the whole track. A round's small table of chunks, a row for each, is all
that is kept by participant; a chunk whose box lies wholly within reach of a reference is
passed without being read. Tracks within one chunk have no part in the rounds, and the last
pass reads the tracks of a task as a stream, so any number of short ones costs their points.

At worst (chains that never meet) a round settles one more chunk of each participant.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wayspark.functions.durable import durable, release

#: Points of a chunk.
CHUNK = 1 << 16
_BOX = ("lat0", "lat1", "lon0", "lon1")
_REF = ("ref_at", "ref_ts", "ref_lat", "ref_lon")
_REF_SCHEMA = "ref_at long, ref_ts timestamp_ntz, ref_lat double, ref_lon double"

Ref = tuple[int, datetime, float, float]
#: Whether a point (ts, lat, lon) becomes the reference after ``ref``.
Replaces = Callable[[Ref, datetime, float, float], bool]
#: Whether no point in the box (lat0, lat1, lon0, lon1) does, for sure.
Passes = Callable[[Ref, tuple[float, float, float, float]], bool]


def _ref_of(row, names=_REF) -> Ref | None:
    at = row[names[0]]
    return None if pd.isna(at) else (int(at), *(none if row[n] is None else row[n] for n, none in zip(names[1:], (pd.NaT, float("nan"), float("nan")), strict=True)))


def _walk(df: pd.DataFrame, ref: Ref | None, replaces: Replaces):
    """The reference after each row, whether it is new, and the one before."""
    for at, ts, lat, lon in zip(df["at"], df["ts"], df["lat"], df["lon"], strict=True):
        before, new = ref, ref is None or replaces(ref, ts, lat, lon)
        if new:
            ref = (at, ts, lat, lon)
        yield ref, new, before


def follow(points: DataFrame, replaces: Replaces, passes: Passes | None = None, chunk: int = CHUNK) -> DataFrame:
    """Points in the order of (participant_id, ts, event_id) with ``at``, ``is_ref``, ``ref_at`` and ``before_at``.

    ``at`` numbers the points; ``ref_at`` is that of the reference after the point and
    ``before_at`` of the one before it (null at a participant's first point).
    """
    order = ("participant_id", "ts", "event_id")
    pid = points.schema["participant_id"].dataType.simpleString()
    dealt = points.select("participant_id", "event_id", "ts", "lat", "lon").repartitionByRange(*order).sortWithinPartitions(*order)
    own = durable(dealt.withColumn("at", F.monotonically_increasing_id()).withColumn("chunk", F.floor(F.col("at") / chunk)), "track")
    box = [f(c).alias(n) for n, (c, f) in zip(_BOX, (("lat", F.min), ("lat", F.max), ("lon", F.min), ("lon", F.max)), strict=True)]
    key = ["participant_id", "chunk"]
    table = own.groupBy(*key).agg(*box).withColumn("due", F.lit(True))
    table = table.withColumn("_chunks", F.count("*").over(W.partitionBy("participant_id"))).where("_chunks > 1").drop("_chunks")
    table = durable(table.select("*", *(F.lit(None).cast(t.split()[1]).alias(f"{p}_{t.split()[0]}") for p in ("in", "out") for t in _REF_SCHEMA.split(", "))), "chunks")
    ins, outs = [f"in_{n}" for n in _REF], [f"out_{n}" for n in _REF]

    def end_of(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("at")
        ref = _ref_of(df.iloc[0], ins)
        for ref, _, _ in _walk(df, ref, replaces):
            pass
        return pd.DataFrame([(df["participant_id"].iloc[0], df["chunk"].iloc[0], *ref)], columns=[*key, *_REF])

    def agree(df: pd.DataFrame) -> pd.DataFrame:
        """Enter each chunk of a participant with the end of the one before; ``due`` are those that must run for it."""
        df = df.sort_values("chunk").reset_index(drop=True)
        ref, rows = None, []
        for row in df.to_dict("records"):
            was, out = _ref_of(row, ins), _ref_of(row, outs)
            row["due"] = False
            if ref is not None and (was is None or was[0] != ref[0]):
                if passes is not None and passes(ref, tuple(row[b] for b in _BOX)):
                    out = ref
                else:
                    row["due"] = True  # until it has run, what it ended with before is the guess
                row.update(zip(ins, ref, strict=True))
            row.update(zip(outs, out, strict=True))
            ref = out
            rows.append(row)
        return pd.DataFrame(rows, columns=df.columns)

    while not table.where("due").isEmpty():
        due = table.where("due").select(*key, *ins)
        rows = own.join(due, [own["participant_id"].eqNullSafe(due["participant_id"]), own["chunk"] == due["chunk"]]).select(own["participant_id"], own["chunk"], "at", "ts", "lat", "lon", *ins)
        ends = durable(rows.groupBy(*key).applyInPandas(end_of, f"participant_id {pid}, chunk long, {_REF_SCHEMA}"), "ends")
        same = [table["participant_id"].eqNullSafe(ends["participant_id"]), table["chunk"] == ends["chunk"]]
        new = table.join(ends, same, "left").select(*(table[c] for c in table.columns if c not in outs), *(F.coalesce(ends[n], table[o]).alias(o) for n, o in zip(_REF, outs, strict=True)))
        after = durable(new.select(*table.columns).groupBy("participant_id").applyInPandas(agree, table.schema), "chunks")
        release(table)
        release(ends)
        table = after

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ref = None, None
        for batch in batches:
            got = [batch.column(c).to_pylist() for c in (*key, "at")]
            got += [[none if v is None else v for v in batch.column(c).to_pylist()] for c, none in (("ts", pd.NaT), ("lat", float("nan")), ("lon", float("nan")))]
            new, refs, before = [], [], []
            for k, (pid, part, *point) in enumerate(zip(*got, strict=True)):
                if (pid, part) != now:
                    now = (pid, part)
                    ref = _ref_of({n: batch.column(n)[k].as_py() for n in ins}, ins)
                before.append(None if ref is None else ref[0])
                is_new = ref is None or replaces(ref, *point[1:])
                ref = tuple(point) if is_new else ref
                new.append(is_new)
                refs.append(ref[0])
            more = (pa.array(new, pa.bool_()), pa.array(refs, pa.int64()), pa.array(before, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *more], [*kept, "is_ref", "ref_at", "before_at"])

    kept = ["participant_id", "event_id", "ts", "lat", "lon", "at"]
    entered = table.select(*key, *ins)
    rows = own.join(entered, [own["participant_id"].eqNullSafe(entered["participant_id"]), own["chunk"] == entered["chunk"]], "left").select(*(own[c] for c in own.columns), *ins)
    event = points.schema["event_id"].dataType.simpleString()
    out = f"participant_id {pid}, event_id {event}, ts timestamp_ntz, lat double, lon double, at long, is_ref boolean, ref_at long, before_at long"
    # few bytes but much work, so their size must not set the number of tasks
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key).sortWithinPartitions("at").mapInArrow(marked, out)
