"""Operator 3, line dedup by a suffix array over sequences of line ids.

Lines that occur once break runs, so the array holds the suffixes that begin at repeated
lines. Prefix doubling ranks them: at level k a suffix is ranked by its first 2**k lines,
the pair of its rank and that of the suffix 2**(k-1) lines on, and a range sort of the
distinct pairs gives the next ranks. Two ranks of level k name the LCP interval of any
depth from 2**k to 2**(k+1): the suffixes that agree in so many lines.

A run is repeated if it has ``min_words`` words and its interval has an earlier suffix, by
doc_id and line. It suffices to look at the shortest such runs, forward from each line
and backward: together they cover the maximal repeated runs and nothing else. Levels end
at the longest of them. Lines of later copies are deleted, so the first copy of every
line stays.

Edge cases: a null text stays null and has no lines. Repeated rows are copies like any
other; of rows with equal doc_ids one, always the same in a run, counts as first, and a
null doc_id counts as last. Blank lines belong to runs but hold no words. Other columns
are kept, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from wayspark.functions.durable import durable, release
from wayspark.llm.columns import whole_row

MIN_WORDS = 10
_LAST = (1 << 63) - 1


def shortest_runs(words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line, the length of the shortest run from it (to it) with enough words, or 0."""
    total = np.concatenate([[0], np.cumsum(words)])
    n = len(words)
    end = np.searchsorted(total, total[:-1] + min_words, "left")
    ahead = np.where(end <= n, end - np.arange(n), 0)
    start = np.searchsorted(total, total[1:] - min_words, "right") - 1
    back = np.where(start >= 0, np.arange(1, n + 1) - start, 0)
    return np.maximum(ahead, 0), back


def _lines(table: DataFrame, min_words: int) -> DataFrame:
    """One row for each line of every text."""

    def run(batches):
        for batch in batches:
            for uid, doc, text in zip(*(batch.column(k) for k in range(3)), strict=True):
                if not text.is_valid:
                    continue
                raw = text.as_py().encode("utf-8", "surrogatepass").split(b"\n")
                words = np.fromiter((len(x.split()) for x in raw), np.int64, len(raw))
                ahead, back = shortest_runs(words, min_words)
                h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, raw)), dtype="<i8").reshape(-1, 2)
                n = len(raw)
                yield pa.RecordBatch.from_pydict({
                    "uid": pa.array(np.full(n, uid.as_py())), "doc": pa.array(np.full(n, doc.as_py())), "line": pa.array(np.arange(n)),
                    "r": pa.array(h[:, 0].copy()), "r2": pa.array(h[:, 1].copy()), "words": pa.array(words), "ahead": pa.array(ahead.astype(np.int64)), "back": pa.array(back.astype(np.int64)),
                })

    kind = "uid long, doc long, line long, r long, r2 long, words long, ahead long, back long"
    return table.select("uid", F.coalesce(F.col("doc.doc_id").cast("long"), F.lit(_LAST)).alias("id"), F.col("doc.text").alias("text")).mapInArrow(_merged(run), kind)


def _merged(run, rows: int = 20_000):
    """Small batches of ``run`` put together."""

    def merged(batches):
        held, n = [], 0
        for batch in run(batches):
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return merged


def ranked(pairs: DataFrame) -> DataFrame:
    """r, r2, rank for distinct pairs with counts n: one plus the count of all smaller pairs.

    A range sort spreads the pairs, those of a frequent r too; tasks number their own
    part, and the parts' totals, one row a task, are added up.
    """
    spark = pairs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def number(batches):
        before = 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            local = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("r"), batch.column("r2"), pa.array(local), batch.column("n")], names=["part", "r", "r2", "local", "n"])

    numbered = durable(
        pairs.repartitionByRange(parts, "r", "r2").sortWithinPartitions("r", "r2").withColumn("part", F.spark_partition_id())
        .mapInArrow(number, "part int, r long, r2 long, local long, n long"), "ranks",
    )
    totals = numbered.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    before, offsets = 1, []
    for t in totals:
        offsets.append((t.part, before))
        before += t.n
    table = spark.createDataFrame(offsets, "part int, before long")
    return numbered.join(F.broadcast(table), "part").select("r", "r2", (F.col("local") + F.col("before")).alias("rank"))


def suffix_ranks(lines: DataFrame, min_words: int) -> tuple[DataFrame, int]:
    """The suffixes that begin at repeated lines, with rank0, rank1, ... by level."""
    pairs = lines.groupBy("r", "r2").agg(F.count("*").alias("n")).where("n > 1")
    known = lines.join(ranked(pairs), ["r", "r2"]).drop("r", "r2").withColumnRenamed("rank", "rank0")
    text = W.partitionBy("uid").orderBy("line")
    stretch = W.partitionBy("uid", "stretch")
    here = (
        known.withColumn("stretch", F.col("line") - F.row_number().over(text))
        .withColumns({"first": F.min("line").over(stretch), "last": F.max("line").over(stretch), "all": F.sum("words").over(stretch)})
        .where(F.col("all") >= min_words)
        .withColumn("ahead", F.when(F.col("line") + F.col("ahead") - 1 <= F.col("last"), F.col("ahead")).otherwise(0))
        .withColumn("back", F.when(F.col("line") - F.col("back") + 1 >= F.col("first"), F.col("back")).otherwise(0))
        .select("uid", "doc", "line", "last", "ahead", "back", "rank0")
    )
    here = durable(here, "suffixes")
    longest = here.agg(F.max(F.greatest("ahead", "back"))).first()[0] or 0
    level = 0
    while 2 << level <= longest:
        step = 1 << level
        beyond = F.when(F.col("line") + step <= F.col("last"), F.lead(f"rank{level}", step).over(text)).otherwise(0)
        paired = durable(here.withColumn("r", F.col(f"rank{level}")).withColumn("r2", beyond), "pairs")
        ranks = ranked(paired.groupBy("r", "r2").agg(F.count("*").alias("n")))
        after = durable(paired.join(ranks, ["r", "r2"]).drop("r", "r2").withColumnRenamed("rank", f"rank{level + 1}"), "suffixes")
        release(here)
        release(paired)
        here, level = after, level + 1
    return here, level


def _runs(suffixes: DataFrame, levels: int) -> DataFrame:
    """Every shortest run: uid, doc, line, length and the ranks that name its interval."""
    names = [f"rank{k}" for k in range(levels + 1)]
    columns = ["line", "ahead", "back", *names]

    def run(batches):
        for batch in batches:
            held = batch.column("rows")
            at = held.offsets.to_numpy()
            flat = {c: held.flatten().field(c).to_numpy() for c in columns}
            rank = np.stack([flat[n] for n in names])
            owner = np.repeat(np.arange(len(held)), np.diff(at))
            out = []
            for way in ("ahead", "back"):
                i = np.flatnonzero(flat[way] > 0)
                length = flat[way][i]
                start = i if way == "ahead" else i - length + 1
                k = np.floor(np.log2(length)).astype(np.int64)
                k -= (1 << k) > length
                out.append(np.stack([owner[i], flat["line"][start], length, rank[k, start], rank[k, start + length - (1 << k)]]))
            o, line, length, a, b = np.unique(np.concatenate(out, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([
                batch.column("uid").take(pa.array(o)), batch.column("doc").take(pa.array(o)), *(pa.array(np.ascontiguousarray(x)) for x in (line, length, a, b)),
            ], names=["uid", "doc", "line", "length", "a", "b"])

    grouped = suffixes.groupBy("uid", "doc").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("rows"))
    return grouped.mapInArrow(run, "uid long, doc long, line long, length long, a long, b long")


def later_copies(runs: DataFrame) -> DataFrame:
    """The runs whose interval has an earlier suffix.

    The first ones are written before the join, so that AQE can split frequent intervals.
    """
    name = ["length", "a", "b"]
    first = durable(runs.groupBy(*name).agg(F.min(F.struct("doc", "uid", "line")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "first")
    return runs.join(first, name).where(F.struct("doc", "uid", "line") > F.col("first")).select("uid", "line", "length")


def kept_lines(n: int, runs: list[tuple[int, int]]) -> np.ndarray:
    """Which of ``n`` lines no run (start, length) covers."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for start, length in runs:
        edge[start] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of ``docs`` in ``doc``, with what is left of every text.

    Beside them: ``left`` (the text), ``n_lines``, ``n_removed``, ``has_words`` (whether
    what is left has a word) and ``removed``, the deleted runs as structs of the first
    line, from 0, and the length.
    """
    table = durable(docs.select(F.monotonically_increasing_id().alias("uid"), whole_row(docs).alias("doc")), "texts")
    lines = durable(_lines(table, min_words), "lines")
    suffixes, levels = suffix_ranks(lines, min_words)
    release(lines)
    runs = durable(_runs(suffixes, levels), "runs")
    release(suffixes)
    gone = later_copies(runs).groupBy("uid").agg(F.collect_list(F.struct("line", "length")).alias("runs"))

    def cut(batches):
        for batch in batches:
            rows = []
            for text, runs in zip(batch.column("text"), batch.column("runs"), strict=True):
                if not text.is_valid:
                    rows.append((None, 0, 0, False, []))
                    continue
                whole = text.as_py()
                if not runs.is_valid:
                    rows.append((whole, whole.count("\n") + 1, 0, bool(whole.encode("utf-8", "surrogatepass").strip()), []))
                    continue
                parts = whole.split("\n")
                keep = kept_lines(len(parts), [(r["line"], r["length"]) for r in runs.as_py()])
                edges = np.flatnonzero(np.diff(np.concatenate([[True], keep, [True]]).astype(np.int8))).reshape(-1, 2)
                left = "\n".join(p for p, k in zip(parts, keep, strict=True) if k)
                removed = [{"line": int(a), "length": int(b - a)} for a, b in edges]
                rows.append((left, len(parts), int((~keep).sum()), bool(left.encode("utf-8", "surrogatepass").strip()), removed))
            left, n, m, words, removed = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([
                batch.column("doc"), pa.array(left, pa.string()), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(words, pa.bool_()),
                pa.array(removed, pa.list_(pa.struct([("line", pa.int64()), ("length", pa.int64())]))),
            ], names=["doc", "left", "n_lines", "n_removed", "has_words", "removed"])

    rest = table.select("uid", F.col("doc").dropFields("text").alias("doc") if len(docs.columns) > 1 else F.struct(F.lit(1).alias("one")).alias("doc"), F.col("doc.text").alias("text"))
    spans = T.ArrayType(T.StructType([T.StructField("line", T.LongType()), T.StructField("length", T.LongType())]))
    kind = T.StructType([rest.schema["doc"], *(T.StructField(n, t) for n, t in (("left", T.StringType()), ("n_lines", T.LongType()), ("n_removed", T.LongType()), ("has_words", T.BooleanType()), ("removed", spans)))])
    return rest.join(gone, "uid", "left").select("doc", "text", "runs").mapInArrow(cut, kind)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select(
        "doc.doc_id", "n_lines", "n_removed",
        F.array_join(F.transform("removed", lambda r: F.concat_ws("+", r["line"], r["length"])), ",").alias("removed_runs"),
        F.sha2("left", 256).alias("left_sha256"),
    )


ORACLE = rf"""
with d as (select row_number() over (order by doc_id) as uid, doc_id, string_split(text, chr(10)) as l from documents),
n as (select *, list_transform(l, lambda x: len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> ''))) as n from d where l is not null),
i as (select uid, unnest(range(1, len(n) + 1)) as i, unnest(n) as n from n),
c as (select uid, i, sum(n) over (partition by uid order by i) as upto, sum(n) over (partition by uid order by i) - n as before from i),
w as (select a.uid, a.i as i, min(b.i) as j from c a join c b on a.uid = b.uid and b.upto >= a.before + {MIN_WORDS} group by a.uid, a.i
      union select b.uid, max(a.i) as i, b.i as j from c a join c b on a.uid = b.uid and b.upto >= a.before + {MIN_WORDS} group by b.uid, b.i),
g as (select uid, i, j, array_to_string(l[i:j], chr(10)) as run from w join d using (uid)),
f as (select run, min(struct_pack(uid := uid, i := i)) as first from g group by run),
r as (select distinct uid, unnest(range(i, j + 1)) as i from g join f using (run) where (uid, i) > (first.uid, first.i)),
s as (select uid, i, i - row_number() over (partition by uid order by i) as stretch from r),
t as (select uid, min(i) as i, count(*) as k from s group by uid, stretch),
o as (select uid, string_agg((i - 1) || '+' || k, ',' order by i) as runs, sum(k) as k from t group by uid),
k as (select uid, string_agg(x, chr(10) order by i) as left from
      (select uid, unnest(l) as x, unnest(range(1, len(l) + 1)) as i from d) anti join r using (uid, i) group by uid)
select doc_id, coalesce(len(l), 0)::BIGINT as n_lines, coalesce(o.k, 0)::BIGINT as n_removed, coalesce(o.runs, '') as removed_runs,
       case when l is not null then sha256(coalesce(k.left, '')) end as left_sha256
from d left join o using (uid) left join k using (uid)
"""

QUERIES = {"op3_line_dedup": query}
ORACLE_SQL = {"op3_line_dedup": ORACLE}
