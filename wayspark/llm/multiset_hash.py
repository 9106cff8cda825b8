"""Operator 2, document fingerprints by a homomorphic multiset hash.

Every paragraph (a line) is hashed to a wide vector, and a text's fingerprint is the sum
of its paragraphs' vectors: FULL lanes modulo 2**64 that decide equality, and SKETCH lanes
modulo 2**32 into which the paragraph's word pairs are counted with signs. Sums don't
depend on the order, and a paragraph is put in or taken out by adding or subtracting its
vector. The squared distance of two sketches estimates how many pairs differ, so one less
its share of both squared lengths is their likeness.

Documents meet their neighbour by doc_id in one shuffle: blocks of ids come from quantiles
over all ids, each block also gets the first row of the block that follows it, and tasks
read their blocks in order. An id with more rows than a block is parted by hashes of texts.

Edge cases: a null text counts as empty, an empty text is one empty paragraph. Rows with
equal doc_ids follow each other by text (by a hash of it and the row number, if they fill blocks); a null
doc_id comes last. A single row is its own
next one. Fingerprints without any pair are like each other only if they are equal. Other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FULL, SKETCH = 8, 128
#: Rows in a block of neighbouring ids, and blocks at most (they grow beyond).
BLOCK_ROWS, MAX_BLOCKS = 500, 1 << 16
_LEAST = -(1 << 63)


class Fingerprint:
    """A sum of paragraph vectors; texts with the same paragraphs have equal ones."""

    __slots__ = ("full", "sketch")

    def __init__(self, full: np.ndarray | None = None, sketch: np.ndarray | None = None):
        self.full = np.zeros(FULL, np.uint64) if full is None else full
        self.sketch = np.zeros(SKETCH, np.uint32) if sketch is None else sketch

    @classmethod
    def of(cls, text: str | None) -> Fingerprint:
        """The fingerprint of a whole text."""
        out = cls()
        pairs: list[int] = []
        digests = []
        for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
            digests.append(hashlib.blake2b(line, digest_size=8 * FULL).digest())
            pairs += _pairs(line)
            if len(digests) >= 4096 or len(pairs) >= 1 << 16:
                out._add(digests, pairs)
                digests, pairs = [], []
        out._add(digests, pairs)
        return out

    def _add(self, digests: list[bytes], pairs: list[int]) -> None:
        if digests:
            self.full = self.full + np.frombuffer(b"".join(digests), "<u8").reshape(-1, FULL).sum(axis=0, dtype=np.uint64)
        if pairs:
            h = np.array(pairs, np.uint64)
            lane = (h % np.uint64(2 * SKETCH)).astype(np.int64)
            n = np.bincount(lane, minlength=2 * SKETCH)
            self.sketch = self.sketch + (n[:SKETCH] - n[SKETCH:]).astype(np.uint32)

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.full + other.full, self.sketch + other.sketch)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.full - other.full, self.sketch - other.sketch)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Fingerprint) and self.hex() == other.hex()

    def __hash__(self) -> int:
        return hash(self.hex())

    def hex(self) -> str:
        return self.full.astype("<u8").tobytes().hex() + self.sketch.astype("<u4").tobytes().hex()

    def likeness(self, other: Fingerprint) -> float:
        """From 0 to 1; 1 only if the fingerprints are equal."""
        if (self.full == other.full).all():
            return 1.0
        a, b = self.sketch.view(np.int32).astype(np.float64), other.sketch.view(np.int32).astype(np.float64)
        size = float(a @ a + b @ b)
        apart = float((a - b) @ (a - b))
        return min(max(1 - apart / size, 0.0), 1 - 2**-20) if size else 0.0


def _pairs(line: bytes) -> list[int]:
    """Hashes of a paragraph's word pairs, or of its only word."""
    words = line.split()
    digest = xxhash.xxh3_64_intdigest
    if len(words) < 2:
        return [digest(w) for w in words]
    return [digest(a + b" " + b) for a, b in zip(words, words[1:])]


def paragraph(text: str) -> Fingerprint:
    """The vector of one paragraph, to put in or take out."""
    return Fingerprint.of(text.replace("\n", " "))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and ``fingerprint`` (hex) of every text, without a shuffle."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([Fingerprint.of(t.as_py()).hex() for t in batch.column(1)], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string")


class Cuts:
    """Blocks of (key, hash) in ascending order; a key that is several quantiles is parted by hash."""

    def __init__(self, quantiles: list[int]):
        self.keys, self.times = np.unique(np.array(quantiles, np.int64), return_counts=True)
        self.base = np.concatenate([[0], np.cumsum(self.times)])
        self.hot = self.keys[self.times > 1]

    def of(self, key: np.ndarray, h: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, key, "left")
        if not len(self.hot):
            return at.astype(np.int32)
        near = np.minimum(at, len(self.keys) - 1)
        part = ((h.astype(np.float64) / 2.0**64 + 0.5) * self.times[near]).astype(np.int64)
        part = np.where((at == near) & (self.keys[near] == key), np.minimum(part, self.times[near] - 1), 0)
        return (self.base[at] + part).astype(np.int32)


def in_blocks(docs: DataFrame) -> DataFrame:
    """block, extra, doc_id, text: rows by descending doc_id in blocks, each block in one task.

    A block ends with rows marked ``extra``: the first of them is the row that follows.
    The driver holds two numbers a block, at most 2 * MAX_BLOCKS.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    n = rows.count()
    blocks = min(MAX_BLOCKS, max(1, n // BLOCK_ROWS))
    cuts = Cuts(rows.agg(F.percentile_approx("key", [k / blocks for k in range(1, blocks)] or [0.5], max(10_000, 10 * blocks))).first()[0] or [0])
    hot = F.col("key").isin(*map(int, cuts.hot)) if len(cuts.hot) else F.lit(False)
    # the row's number parts rows that are equal in all
    rows = rows.withColumn("h", F.when(hot, F.xxhash64("text", F.monotonically_increasing_id())).otherwise(F.lit(0).cast("long")))

    @F.pandas_udf("int")
    def block_of(key: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(cuts.of(key.to_numpy(), h.to_numpy()))

    heads = sorted((r.block, r.head.key, r.head.h) for r in rows.select("key", "h", block_of("key", "h").alias("block")).groupBy("block").agg(F.max(F.struct("key", "h")).alias("head")).collect())
    own = {b: (k, h, heads[(i + 1) % len(heads)][0]) for i, (b, k, h) in enumerate(heads)}

    @F.pandas_udf("array<int>")
    def blocks_of(key: pd.Series, h: pd.Series) -> pd.Series:
        at = cuts.of(key.to_numpy(), h.to_numpy())
        return pd.Series([[b, own[b][2]] if own[b][:2] == (k, x) else [b] for b, k, x in zip(at.tolist(), key.tolist(), h.tolist(), strict=True)])

    if not heads:
        return spark.createDataFrame([], "block int, extra int, doc_id long, text string")
    return (
        rows.select("key", "h", "doc_id", "text", F.posexplode(blocks_of("key", "h")).alias("extra", "block"))
        .repartition("block").sortWithinPartitions("block", "extra", F.desc("key"), F.desc("h"), "text").select("block", "extra", "doc_id", "text")
    )


def edited_text(text: str, following: str) -> str:
    """The last half of ``text`` (rounded down) replaced by as much of ``following``."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def with_edits(docs: DataFrame) -> DataFrame:
    """Every text's fingerprint beside that of its edited text and its next document's."""

    def run(batches):
        last = None  # block, doc_id, text, fingerprint of the row that waits for the next
        for batch in batches:
            out = []
            for block, extra, key, text in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                if extra and (last is None or last[0] != block):
                    continue
                text = text.as_py() or ""
                now = Fingerprint.of(text)
                if last is not None and last[0] == block:
                    edited = edited_text(last[2], text)
                    other = Fingerprint.of(edited)
                    out.append((last[1], len(last[2]), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), last[3].hex(), other.hex(), last[3].likeness(other), last[3].likeness(now)))
                last = None if extra else (block, key, text, now)
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return in_blocks(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_fingerprints": query}
ORACLE_SQL: dict[str, str] = {}
