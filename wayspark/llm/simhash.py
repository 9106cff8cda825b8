"""Operator 8, SimHash near-dedup by the generalised pigeonhole principle.

Fingerprints within ``max_bits`` of each other are linked. Equal fingerprints are one
row from the start. Bits that go together over the corpus are put into one partition; a
partition with threshold t is probed under every way of leaving out t of its bits, so two
fingerprints within t there share a key. If the thresholds t, each plus one, sum up to
``max_bits + 1``, no link is missed. Dynamic programming picks the thresholds (-1: not
probed) with the fewest candidates, by counts of equal keys over all fingerprints and how
often each bit differs; the number of partitions is the cheapest of PARTITIONS.

Sums by key are written before they are joined, so that AQE can split frequent keys. A key
that many fingerprints share isn't compared pair by pair: its other bits are
partitioned again, level by level, until few fingerprints share all the bits kept or
SMALL_BITS bits are free, which at most 2**SMALL_BITS different fingerprints can share.

Edge cases: a null, empty or blank text has fingerprint 0, which links like any other.
Repeated rows and texts share a fingerprint and a component. Without links a document is
its own component; a null doc_id has a null component if all of its component are null.
Long texts are hashed in parts. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayspark.operators.components import components
from wayspark.functions.durable import durable
from wayspark.llm.columns import whole_row

SHINGLE, MAX_BITS, SEED = 3, 2, 42
#: Bytes of a text that are split into words at once.
PART = 1 << 20
PARTITIONS = (2, 3, 4)
#: Fingerprints under one key that are compared with each other.
BUCKET = 64
SMALL_BITS = 7

_SPACE = regex.compile(rb"[\x20\x09-\x0D]")


def word_parts(raw: bytes, overlap: int, size: int = PART) -> Iterator[list[bytes]]:
    """The words of ``raw`` in lists, each beginning with the last ``overlap`` words before it."""
    at, last = 0, []
    while at < len(raw):
        found = _SPACE.search(raw, at + size)
        end = found.start() if found else len(raw)
        words = last + raw[at:end].split()
        yield words
        last, at = words[len(words) - overlap :] if overlap and len(words) > overlap else (words if overlap else []), end


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64 bits, unsigned: each is set if it is set in over half the shingles' hashes."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    total, ones = 0, np.zeros(64, dtype=np.int64)
    few: list[bytes] = []
    digest = xxhash.xxh64_intdigest
    for words in word_parts(raw, shingle - 1):
        few = words
        n = len(words) - shingle + 1
        if n < 1:
            continue
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(sizes)
        joined = b" ".join(words)
        spans = zip((ends - sizes)[:n].tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)
        h = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
        for k in range(0, n, 1 << 16):
            ones += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += n
    if not total:
        return digest(b" ".join(few), SEED) if few else 0
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and ``fp``, the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and how many have both of any two bits set."""

    def run(batches):
        both = np.zeros((64, 64), dtype=np.int64)
        n = 0
        for batch in batches:
            value = batch.column(0).to_numpy()
            for k in range(0, len(value), 1 << 14):
                x = np.unpackbits(value[k : k + (1 << 14)].astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                both += (x.T @ x).astype(np.int64)
            n += len(value)
        at, to = np.nonzero(both)
        yield pa.RecordBatch.from_pydict({"a": pa.array([-1, *at.tolist()]), "b": pa.array([-1, *to.tolist()]), "n": pa.array([n, *both[at, to].tolist()])})

    rows = fps.select("fp").mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
    both, n = np.zeros((64, 64)), 0
    for r in rows:
        if r.a < 0:
            n = r.n
        else:
            both[r.a, r.b] = r.n
    return n, both


def correlation(n: int, both: np.ndarray) -> np.ndarray:
    """The absolute correlation of any two bits; a bit that never changes has none."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(p * (1 - p))
    with np.errstate(divide="ignore", invalid="ignore"):
        r = (both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    return np.abs(np.nan_to_num(r, posinf=0, neginf=0))


def group_bits(bits: list[int], parts: int, corr: np.ndarray) -> list[list[int]]:
    """Partitions of nearly equal width; each grows by the bit that goes best with it."""
    left, out = list(bits), []
    for k in range(parts):
        width = len(left) // (parts - k)
        group = [max(left, key=lambda b: corr[b, left].sum())]
        left.remove(group[0])
        while len(group) < width:
            group.append(max(left, key=lambda b: corr[b, group].sum()))
            left.remove(group[-1])
        out.append(sorted(group))
    return out


def distance_odds(p: np.ndarray, most: int) -> np.ndarray:
    """The odds that two fingerprints differ in at most 0, 1, ... of these bits."""
    odds = np.zeros(most + 1)
    odds[0] = 1
    for x in p:
        differ = 2 * x * (1 - x)
        odds = odds * (1 - differ) + np.concatenate([[0], odds[:-1]]) * differ
    return np.cumsum(odds)


def allot(costs: list[list[float]], budget: int) -> tuple[float, list[int]]:
    """Thresholds, each at least -1, whose values plus one sum up to ``budget``.

    ``costs[i][t + 1]`` is the cost of threshold t for partition i.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, picks) in best.items():
            for k in range(min(len(row), budget - used + 1)):
                cand = (cost + row[k], [*picks, k - 1])
                if used + k not in nxt or cand < nxt[used + k]:
                    nxt[used + k] = cand
        best = nxt
    return best[budget]


def mask_of(bits) -> int:
    """The bits as a signed long."""
    return int(np.array(sum(1 << b for b in bits), dtype=np.uint64).view(np.int64))


def masks_for(groups: list[list[int]], thresholds: list[int]) -> list[int]:
    """Bits kept: for threshold t every way of leaving out t of a partition's bits."""
    return sorted({mask_of(set(g) - set(out)) for g, t in zip(groups, thresholds, strict=True) if t >= 0 for out in combinations(g, min(t, len(g)))})


def choose_masks(fps: DataFrame, max_bits: int = MAX_BITS, partitions=PARTITIONS) -> tuple[list[int], np.ndarray]:
    """The masks to probe first, and the bits' correlation.

    Candidates at threshold 0 are counted over all fingerprints; those at higher ones
    follow from how often each bit differs. A probe costs as much as a candidate.
    """
    n, both = bit_counts(fps)
    p, corr = np.diag(both) / max(n, 1), correlation(n, both)
    plans = {m: group_bits(list(range(64)), m, corr) for m in partitions}
    keys = [F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.col("fp").bitwiseAND(mask_of(g)).alias("key")) for m, groups in plans.items() for i, g in enumerate(groups)]
    same = fps.select(F.explode(F.array(*keys)).alias("k")).groupBy("k.m", "k.i", "k.key").agg(F.count("*").alias("n"))
    pairs = {(r.m, r.i): float(r.pairs) for r in same.groupBy("m", "i").agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2).alias("pairs")).collect()}
    options = []
    for m, groups in plans.items():
        costs = []
        for i, g in enumerate(groups):
            odds = distance_odds(p[g], max_bits)
            row = [0.0]
            for t in range(max_bits + 1):
                probes = len(list(combinations(g, t)))
                row.append(probes * n + max(pairs.get((m, i), 0.0), odds[0] * n * n / 2) * odds[t] / max(odds[0], 1e-300))
            costs.append(row)
        options.append((*allot(costs, max_bits + 1), m))
    _, thresholds, m = min(options)
    return masks_for(plans[m], thresholds), corr


def links(fps: DataFrame, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """u, v (u > v): the different fingerprints that differ in at most ``max_bits`` bits."""
    spark = fps.sparkSession
    masks, corr = choose_masks(fps, max_bits)
    rows = fps.select("fp", F.explode(F.array(*map(F.lit, masks))).alias("mask"))
    found = None
    while True:
        rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = durable(rows.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
        rows = durable(rows.join(sizes, ["mask", "key"]), "probes")
        small = (F.col("n") <= bucket) | (F.bit_count("mask") >= 64 - SMALL_BITS)
        a = rows.where(small).select("mask", "key", F.col("fp").alias("u"))
        b = rows.where(small).select("mask", "key", F.col("fp").alias("v"))
        near = (
            a.join(b, ["mask", "key"]).where((F.col("u") > F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits))
            .select("u", "v").distinct()
        )
        found = near if found is None else found.unionByName(near)
        large = rows.where(~small)
        parents = [r.mask for r in large.select("mask").distinct().collect()]  # as many as there are masks
        if not parents:
            return durable(found.distinct(), "near")
        next_: list[tuple[int, int]] = []
        for mask in parents:
            free = [k for k in range(64) if not mask >> k & 1]
            for g in group_bits(free, min(max_bits + 1, len(free)), corr):
                next_.append((mask, int(np.int64(mask) | np.int64(mask_of(g)))))
        children = spark.createDataFrame(next_, "mask long, child long")
        rows = large.join(F.broadcast(children), "mask").select("fp", F.col("child").alias("mask")).distinct()


def classes(rows: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """fp, least for every fingerprint of ``rows`` (fp, first).

    ``least`` is the smallest ``first``, of any type with an order, in all its component.
    """
    fps = durable(rows.groupBy("fp").agg(F.min("first").alias("first")), "fps")
    roots = components(links(fps, max_bits)).withColumnRenamed("node", "fp")
    members = durable(roots.join(fps, "fp"), "members")
    least = durable(members.groupBy("root").agg(F.min("first").alias("least")), "least")
    linked = members.join(least, "root").select("fp", "least")
    return durable(fps.join(linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("least")), "classes")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp, component_id for every row of ``docs``."""
    own = durable(fingerprints(docs, shingle), "fingerprints")
    found = classes(own.select("fp", F.col("doc_id").alias("first")), max_bits)
    return own.join(found, "fp", "left").select("doc_id", "fp", F.col("least").alias("component_id"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of their component, one row of each."""
    table = durable(docs.select(F.monotonically_increasing_id().alias("uid"), whole_row(docs).alias("doc")), "texts")
    ids = F.coalesce(F.col("doc.doc_id").cast("long"), F.lit((1 << 63) - 1))
    # the row's number stands for it: ids may repeat
    own = durable(fingerprints(table.select(F.col("uid").alias("doc_id"), F.col("doc.text").alias("text")), shingle).withColumnRenamed("doc_id", "uid"), "fingerprints")
    named = own.join(table.select("uid", ids.alias("id")), "uid")
    first = classes(named.select("fp", F.struct("id", "uid").alias("first")), max_bits).select(F.col("least.uid").alias("uid")).distinct()
    return table.join(first, "uid", "left_semi").select("doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


QUERIES = {"op8_simhash_near_dedup": query}
ORACLE_SQL: dict[str, str] = {}
