"""Near copies by SimHash and MinHash candidates, verified by exact Jaccard similarity.

Two texts are near copies if their sets of five-word shingles have a similarity of 4/5 or
more. Texts with equal sets are one from the start. Candidates come from operator 8, that
is, from SimHash fingerprints of the sets within SIM_BITS bits, found by the generalised
pigeonhole principle; and, as most texts of that similarity are farther apart (some 10 of 64
bits, for which no partition leaves a key that selects), from BANDS keys of ROWS MinHashes
each. A pair of similarity 4/5 shares a key with a probability of 1 - (1 - 0.8**5)**20, which
is 0.9996, and the more alike, the likelier. Of those that share a key, pairs of similarity 4/5
have LIKELY of their 100 MinHashes in common with a probability of 0.9998, those of 1/2 with
0.001; the others aren't candidates. Every candidate is verified on the whole sets.

Under a key that more than ``bucket`` texts share, they are held against LEADERS of them, and
what is linked by then isn't compared again. What is left open there is parted by keys of
more MinHashes: DEEP_BANDS of DEEP_ROWS, of which a pair of similarity 4/5
shares one with a probability of 0.995, one of similarity 1/2 with 0.005.

Edge cases: words are parted by ASCII space, and compared with ASCII letters in lower case.
A text of fewer than five words is one shingle. Null, empty and blank texts are equal.
Shingles are known by 64-bit hashes. A row with null doc_id stays only if no other is in
its component; of repeated rows one stays. Other columns are kept, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayspark.functions.durable import durable, release
from wayspark.llm import simhash
from wayspark.llm.columns import whole_row
from wayspark.operators.components import components

SHINGLE, SEED, SIM_BITS = 5, 42, 3
BANDS, ROWS = 20, 5
#: MinHashes that candidates have in common, of BANDS times ROWS.
LIKELY = 66
DEEP_BANDS, DEEP_ROWS = 150, 15
#: Texts under one key that are compared with each other.
BUCKET = 64
#: Texts under a key of more that all others are held against.
LEADERS = 8
#: Ids that are broadcast; more are joined by a shuffle.
MAX_BROADCAST = 1_000_000


class _Words(dict):
    """Hashes of words, a bounded number of them remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 18:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return h


def shingle_set(text: str | None, words: dict | None = None, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of the different shingles, in order."""
    own = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not own:
        return np.zeros(0, np.int64)
    words = _Words() if words is None else words
    w = np.fromiter(map(words.__getitem__, own), np.uint64, len(own))
    size = min(shingle, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            h = (h ^ w[k : len(w) - size + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return np.unique(h.view(np.int64))


def _factors(n: int, seed: int) -> np.ndarray:
    """Odd numbers, each of which permutes 64-bit hashes."""
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def min_hashes(grams: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """The smallest hash of a set under each of ``n`` permutations."""
    h, factors = grams.view(np.uint64), _factors(n, seed)
    least = np.full(n, (1 << 64) - 1, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(h), 2048):
            np.minimum(least, (h[at : at + 2048, None] * factors).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray, bands: int) -> np.ndarray:
    """A key for each band: a hash of the band's number and its MinHashes."""
    with np.errstate(over="ignore"):
        key = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for x in least.reshape(bands, -1).T:
            key = (key ^ x) * np.uint64(0xBF58476D1CE4E5B9)
            key ^= key >> np.uint64(31)
    return key.view(np.int64)


def sketch_of(least: np.ndarray) -> np.ndarray:
    """One byte of each MinHash."""
    with np.errstate(over="ignore"):
        return ((least * np.uint64(0x94D049BB133111EB)) >> np.uint64(56)).astype(np.uint8).view(np.int8)


def sim_bits(grams: np.ndarray) -> int:
    """The SimHash of a set, as a signed long: bits that are set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(grams), 1 << 14):
        ones += np.unpackbits(grams[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(grams), bitorder="little").view(np.int64)[0])


def _arrays(lists: list[np.ndarray], kind=np.int64) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, kind), *lists])))


def signatures(texts: DataFrame) -> DataFrame:
    """uid, n (size of the set), a and b (sums that stand for the set), fp, keys and sketch, from uid and text."""

    def run(batches):
        words = _Words()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(t.as_py(), words) for t in part.column(1)]
                least = [min_hashes(s, BANDS * ROWS) for s in sets]
                with np.errstate(over="ignore"):
                    b = [int(((s ^ (s >> 31)) * np.int64(0x1D8E4E27C47D124F)).sum(dtype=np.int64)) for s in sets]
                    a = [int(s.sum(dtype=np.int64)) for s in sets]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                    pa.array([sim_bits(s) for s in sets], pa.int64()), _arrays([band_keys(x, BANDS) if len(s) else s for x, s in zip(least, sets, strict=True)]), _arrays([sketch_of(x) for x in least], np.int8),
                ], names=["uid", "n", "a", "b", "fp", "keys", "sketch"])

    return texts.select("uid", "text").mapInArrow(run, "uid long, n int, a long, b long, fp long, keys array<long>, sketch array<tinyint>")


def sets_of(texts: DataFrame) -> DataFrame:
    """uid and ``grams``, the whole set."""

    def run(batches):
        words = _Words()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), _arrays([shingle_set(t.as_py(), words) for t in part.column(1)])], names=["uid", "grams"])

    return texts.select("uid", "text").mapInArrow(run, "uid long, grams array<long>")


def deep_keys(sets: DataFrame) -> DataFrame:
    """uid and one row for each of the DEEP_BANDS keys of its set."""

    def run(batches):
        for batch in batches:
            for uid, held in zip(batch.column(0), batch.column(1), strict=True):
                keys = band_keys(min_hashes(held.values.to_numpy(), DEEP_BANDS * DEEP_ROWS, 1), DEEP_BANDS)
                yield pa.RecordBatch.from_arrays([pa.array([uid.as_py()] * len(keys), pa.int64()), pa.array(keys)], names=["uid", "deep"])

    return sets.select("uid", "grams").mapInArrow(run, "uid long, deep long")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs u, v that are near copies."""
    pairs = durable(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "candidates")
    both = pairs.join(sets.select(F.col("uid").alias("u"), F.col("grams").alias("x")), "u").join(sets.select(F.col("uid").alias("v"), F.col("grams").alias("y")), "v")
    out = durable(both.where(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("u", "v"), "near")
    release(pairs)
    return out


def _likely(a: str, b: str):
    same = F.zip_with(a, b, lambda x, y: (x == y).cast("int"))
    return F.aggregate(same, F.lit(0), lambda n, x: n + x) >= LIKELY


def all_pairs(rows: DataFrame, by: list[str]) -> DataFrame:
    """u, v of the rows (uid, root, n, sketch) with equal ``by``, other roots, and sizes and sketches that allow for 4/5."""
    a, b = rows.alias("a"), rows.alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in by]
    fit = (F.col("a.uid") > F.col("b.uid")) & (F.col("a.root") != F.col("b.root")) & (5 * F.least("a.n", "b.n") >= 4 * F.greatest("a.n", "b.n")) & _likely("a.sketch", "b.sketch")
    return a.join(b, on).where(fit).select(F.col("a.uid").alias("u"), F.col("b.uid").alias("v")).distinct()


def leader_pairs(large: DataFrame) -> DataFrame:
    """u, v: every row of ``large`` (key, uid, sketch) with those of the LEADERS of its key that it may be like.

    The leaders are the same ones under many keys.
    """
    lead = large.groupBy("key").agg(*(F.min_by(F.struct("uid", "sketch"), F.struct(F.xxhash64("uid", F.lit(k)), "uid")).alias(f"v{k}") for k in range(LEADERS)))
    lead = durable(lead.select("key", F.explode(F.array_distinct(F.array(*(f"v{k}" for k in range(LEADERS))))).alias("l")).select("key", F.col("l.uid").alias("v"), F.col("l.sketch").alias("led")), "leaders")
    return large.join(lead, "key").where((F.col("uid") != F.col("v")) & _likely("sketch", "led")).select(F.col("uid").alias("u"), "v")


def open_rows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` (key, uid, n, sketch) with their roots, of keys with more than one root."""
    roots = components(found).withColumnRenamed("node", "uid")
    named = durable(rows.select("key", "uid", "n", "sketch").join(roots, "uid", "left").withColumn("root", F.coalesce("root", "uid")), "named")
    mixed = named.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
    return durable(named.join(mixed, "key", "left_semi"), "open")


def links(rows: DataFrame, more: DataFrame, sets: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """u, v: links between near copies, enough to connect all.

    ``rows`` (key, uid, n, sketch, m) are the keys that m > 1 texts share, ``more`` other candidates.
    """
    small, large = rows.where(F.col("m") <= bucket).withColumn("root", F.col("uid")), rows.where(F.col("m") > bucket)
    pairs = all_pairs(small, ["key"]).unionByName(more)
    if large.isEmpty():
        return verified(pairs, sets)
    found = verified(pairs.unionByName(leader_pairs(large)), sets)
    left = open_rows(large, found)
    deep = durable(deep_keys(sets.join(_few(left.select("uid").distinct()), "uid", "left_semi")), "deep")
    own = left.groupBy("uid").agg(*(F.first(c).alias(c) for c in ("root", "n", "sketch")))
    shared = deep.join(deep.groupBy("deep").agg(F.count("*").alias("c")).where("c > 1").select("deep"), "deep", "left_semi").join(own, "uid")
    return durable(found.unionByName(verified(all_pairs(durable(shared, "shared-deep"), ["deep"]), sets)), "links")


def _few(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= MAX_BROADCAST else ids


def sim_candidates(first: DataFrame, max_bits: int = SIM_BITS) -> DataFrame:
    """u, v of ``first`` (uid, fp): texts of one fingerprint, and of fingerprints that operator 8 links."""
    heads = durable(first.groupBy("fp").agg(F.min("uid").alias("head")), "heads")
    near = simhash.links(heads.select("fp"), max_bits)
    equal = first.join(heads, "fp").where("uid <> head").select(F.col("uid").alias("u"), F.col("head").alias("v"))
    a, b = (heads.select(F.col("fp").alias(c), F.col("head").alias(f"h{c}")) for c in "uv")
    return equal.unionByName(near.join(a, "u").join(b, "v").select(F.col("hu").alias("u"), F.col("hv").alias("v")))


def one_of_each(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of their component, one row of each."""
    table = durable(docs.select(F.monotonically_increasing_id().alias("uid"), whole_row(docs).alias("doc")), "texts")
    texts = table.select("uid", F.col("doc.text").alias("text"))
    signed = durable(signatures(texts), "signatures")
    rank = F.struct(F.coalesce(F.col("doc.doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.col("uid"))
    first = durable(table.select("uid", rank.alias("rank")).join(signed.select("uid", "n", "a", "b", "fp"), "uid").groupBy("n", "a", "b", "fp").agg(F.min("rank").alias("rank")).select(F.col("rank.uid").alias("uid"), "rank", "n", "fp"), "different")
    keys = durable(signed.join(first.select("uid"), "uid", "left_semi").select("uid", "n", F.explode("keys").alias("key")), "keys")
    sizes = durable(keys.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "sizes")
    shared = durable(keys.join(sizes, "key").join(signed.select("uid", "sketch"), "uid"), "shared-keys")
    release(keys)
    more = durable(sim_candidates(first.where("n > 0").select("uid", "fp")), "sim-candidates")
    ids = durable(shared.select("uid").unionByName(more.select(F.explode(F.array("u", "v")).alias("uid"))).distinct(), "compared")
    sets = durable(sets_of(texts.join(_few(ids), "uid", "left_semi")), "sets")
    roots = components(links(shared, more, sets, bucket)).withColumnRenamed("node", "uid")
    members = durable(roots.join(first.select("uid", "rank"), "uid"), "members")
    least = members.groupBy("root").agg(F.min("rank").alias("least"))
    copies = signed.select("uid").join(first.select("uid"), "uid", "left_anti")
    gone = durable(copies.unionByName(members.join(least, "root").where("rank <> least").select("uid")), "gone")
    release(sets)
    release(signed)
    return table.join(_few(gone), "uid", "left_anti").select("doc.*")
