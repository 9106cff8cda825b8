"""Operator 1, mixing sources to target weights by Pfair scheduling.

A source of weight w is a task that gets one slot in 1/w: its j-th block (from 0) is
released at floor(j / w), due at ceil((j + 1) / w), and the released block with the
earliest deadline goes next. So after any number t of slots a source has had w * t blocks
up to less than one. Weights are whole numbers over ``parts``, so large that what rounding
takes from a source is less than a block in 2**40 slots.

Every row comes out once. Sources are shuffled by a hash of doc_id; blocks hold ``block``
rows. When a source runs out, the others go on, with their weights scaled up, as a new
phase. A row's place follows from its rank in its source and the slot of its block.

Bounds: MAX_SOURCES sources (ValueError beyond). The driver makes the schedule of all
blocks, a few microseconds each, and writes it as it goes, so that it holds WRITTEN rows of
CHUNK blocks and one open chunk a source. Blocks hold more than ``block`` rows where there
would otherwise be more than ``most`` of them, so this takes half a minute at any size. Up to
BROADCAST blocks the schedule is broadcast, else joined.

Edge cases: a null source counts as an empty name. A null doc_id ranks by its hash like
any other. Repeated rows get places of their own, next to each other in their source.
A source of weight 0, or without a given weight, isn't in the mix: its rows come with null
phase, slot and place. The last block of a source may be short. An empty table gives an
empty result; other columns are kept in ``doc``, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wayspark.functions.durable import durable, new_path
from wayspark.llm.columns import whole_row

PARTS = 1 << 40
BLOCK = 16
#: Blocks of a schedule at most.
MOST = 1 << 24
MAX_SOURCES = 256
#: Sources weigh as the power of their rows, which favours small ones.
POWER = 0.7
SEED = 1
#: Rows that are ranked together.
RANKED = 2000
#: Blocks in a row of the schedule, rows written at once, and blocks of a schedule that is broadcast.
CHUNK, WRITTEN, BROADCAST = 256, 4096, 1 << 20


def whole_parts(weights: Mapping[str, float], parts: int = PARTS) -> dict[str, int]:
    """The positive weights as whole parts of ``parts``, at least one each, by largest remainders."""
    names = sorted(n for n in weights if weights[n] > 0)
    if parts < len(names):
        raise ValueError(f"{len(names)} sources need as many parts at least")
    total = sum(Fraction(weights[n]) for n in names)
    share = {n: parts * Fraction(weights[n]) / total for n in names}
    out = {n: max(1, int(share[n])) for n in names}
    for n in sorted(names, key=lambda n: (int(share[n]) - share[n], n))[: max(0, parts - sum(out.values()))]:
        out[n] += 1
    return out


def order(weights: Mapping[str, int]) -> Iterator[tuple[str, int]]:
    """(source, block) of each slot without end, earliest deadline first."""
    total = sum(weights.values())
    release = [(0, n, 0) for n in sorted(weights)]
    heapq.heapify(release)
    due: list[tuple[int, str, int]] = []
    slot = 0
    while True:
        while release and release[0][0] <= slot:
            _, n, j = heapq.heappop(release)
            heapq.heappush(due, (-(-(j + 1) * total // weights[n]), n, j))
        _, n, j = heapq.heappop(due)
        yield n, j
        heapq.heappush(release, ((j + 1) * total // weights[n], n, j + 1))
        slot += 1


def scheduled(blocks: Mapping[str, int], weights: Mapping[str, int]) -> Iterator[tuple[str, int, int]]:
    """(source, block, phase) of each slot; a source that is out takes no slots from there on."""
    left, had, phase = {n: b for n, b in blocks.items() if b}, dict.fromkeys(blocks, 0), 0
    while left:
        for n, _ in order({n: weights[n] for n in left}):
            yield n, had[n], phase
            had[n] += 1
            left[n] -= 1
            if not left[n]:
                del left[n]
                break
        phase += 1


def schedule(spark: SparkSession, blocks: Mapping[str, int], weights: Mapping[str, int]) -> DataFrame:
    """source, chunk, and the slots and phases of its CHUNK blocks in order."""
    path, schema = new_path(spark, "schedule"), "source string, chunk long, slots array<long>, phases array<int>"
    rows: list[tuple[str, int, list[int], list[int]]] = []
    open_: dict[str, tuple[str, int, list[int], list[int]]] = {}

    def write() -> None:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        rows.clear()

    for slot, (n, j, phase) in enumerate(scheduled(blocks, weights)):
        row = open_.setdefault(n, (n, j // CHUNK, [], []))
        row[2].append(slot)
        row[3].append(phase)
        if j % CHUNK == CHUNK - 1:
            rows.append(open_.pop(n))
            if len(rows) == WRITTEN:
                write()
    rows += open_.values()
    write()
    return spark.read.schema(schema).parquet(path)


def shuffle_key(doc_id, seed: int = SEED):
    """32 hex digits that order a source's rows."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def in_source_order(docs: DataFrame, seed: int = SEED, bins: int | None = None) -> tuple[DataFrame, dict[str, int]]:
    """``docs`` in a struct with its source and ``rank`` in it from 0; and the sources' sizes.

    Rows are ranked in bins of neighbouring keys, whatever their source; a bin's first
    rank in a source is the number of that source's rows in the bins before.
    """
    rows = docs.select(whole_row(docs).alias("doc"), F.coalesce("source", F.lit("")).alias("source"), shuffle_key(F.col("doc_id"), seed).alias("key"))
    sizes = {r.source: r.n for r in rows.groupBy("source").agg(F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()}
    if len(sizes) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    if bins is None:
        bins = min(1 << 20, max(1, sum(sizes.values()) // RANKED))
    rows = rows.withColumn("bin", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * bins / (1 << 32)).cast("int"))
    counts = durable(rows.groupBy("source", "bin").agg(F.count("*").alias("n")), "bins")
    starts = (
        counts.select("source", "bin", (F.sum("n").over(W.partitionBy("source").orderBy("bin")) - F.col("n")).alias("start"))
        .groupBy("bin").agg(F.map_from_entries(F.collect_list(F.struct("source", "start"))).alias("starts"))
    )
    within = W.partitionBy("bin", "source").orderBy("key", F.col("doc.doc_id"))
    ranked = rows.repartition("bin").withColumn("within", F.row_number().over(within) - 1)
    return ranked.join(starts, "bin").select("doc", "source", (F.col("starts")[F.col("source")] + F.col("within")).alias("rank")), sizes


def mixed(docs: DataFrame, weights: Mapping[str, float] | None = None, block: int = BLOCK, parts: int = PARTS, seed: int = SEED, most: int = MOST) -> DataFrame:
    """All rows with their place: doc (all columns of ``docs``), source, rank, phase, slot, place.

    ``slot`` counts the blocks of all sources from 0; ``place`` orders the rows, from 0
    with gaps where a source's last block is short.
    """
    spark = docs.sparkSession
    ranked, sizes = in_source_order(docs, seed)
    shares = whole_parts({n: (weights or {}).get(n, 0) if weights else s**POWER for n, s in sizes.items()}, parts)
    block = max(block, -(-sum(sizes.values()) // most))
    blocks = {n: -(-sizes[n] // block) for n in shares}
    slots = schedule(spark, blocks, shares)
    if sum(blocks.values()) <= BROADCAST:
        slots = F.broadcast(slots)
    placed = ranked.withColumn("block", F.floor(F.col("rank") / block)).withColumn("chunk", F.floor(F.col("block") / CHUNK)).join(slots, ["source", "chunk"], "left")
    at = (F.col("block") % CHUNK).cast("int")
    slot = F.col("slots")[at]
    return placed.select("doc", "source", "rank", F.col("phases")[at].alias("phase"), slot.alias("slot"), (slot * block + F.col("rank") % block).alias("place"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mixed(docs).select("doc.doc_id", "source", "phase", "slot", "place")


QUERIES = {"op1_mixing": query}
ORACLE_SQL: dict[str, str] = {}
