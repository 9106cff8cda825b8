"""Operator 9, quality classifier by importance resampling.

Two generative models over hashed n-grams, one of the target (texts labelled good), one of
all raw text, give every text its log importance ratio. There are three families of
n-grams: characters (orders 1 to 3), words, and pairs of words, hashed into 2**bits buckets
each; a pair's bucket is made of half the bits of either word. The ratio is that of the
mean n-gram: each family's log ratio is divided by its number of n-grams, and their sum
counts ``length`` times, or once for each word of a shorter text. So a long text gets no
further from 0 than its style takes it.

Gumbel noise is added and the top k are kept, which samples k texts without replacement by
their importance. k is the expected number of good texts: the sum over all texts of the odds
that one with such a ratio is labelled good (a logistic curve over the labelled rows). The
noise follows from doc_id and the seed, so a retried task draws the same. Every language,
and rows without one, has models of its own if at least MIN_TARGET target rows are of it and
it is among the MAX_LANGS with most; the others share pooled models over the languages that
have their own, weighted by their raw text, in which n-grams of other languages are rare on
both sides and weigh little.

Bounds: models and curve are fitted on at most ``max_target`` labelled rows (those with the
smallest hashes of their ids); what is broadcast and what reaches the driver is two tables
of MAX_LANGS + 1 times 3 * 2**bits counts and 65,536 histogram rows. The raw model counts
all texts.

Edge cases: a text that is null, empty or blank has no evidence and isn't kept. Without
target rows, or without rows labelled bad, every other text is kept. Rows with equal doc_id
and text share score and fate; rows level with the k-th are kept too. Other columns are kept
by ``resample``, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayspark.functions.durable import durable
from wayspark.llm.columns import whole_row
from wayspark.llm.text_arrays import PIECE, gram_buckets, mixed, pieces, word_hashes

ORDERS = (1, 2, 3)
BITS = 14
FAMILIES = 3
SMOOTHING = 20.0
MAX_TARGET = 20_000
MAX_LANGS, MIN_TARGET = 64, 10
#: Words that a text counts for at most.
LENGTH = 64
SEED = 9
#: The curve and k are found over ratios in steps of 1/STEPS, those beyond CLIP taken together.
STEPS, CLIP = 4, 64


def grams(texts: list[str], orders=ORDERS, bits: int = BITS, size: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Family, buckets, and the text that each n-gram is of."""
    half = np.uint64(64 - bits // 2)
    last = (-1, np.uint64(0))  # text and hash of the last word
    for piece in pieces(texts, max(orders) - 1, size):
        for bucket, text in gram_buckets(piece, orders, bits):
            yield 0, bucket, text
        h, text = word_hashes(piece)
        yield 1, (h >> np.uint64(64 - bits)).astype(np.int64), text
        if not len(h):
            continue
        h, text = np.concatenate([[last[1]], h]), np.concatenate([[last[0]], text])
        last = (text[-1], h[-1])
        part = (mixed(h) >> half).astype(np.int64)
        same = text[1:] == text[:-1]
        yield 2, ((part[:-1] << (bits // 2)) + part[1:])[same], text[1:][same]


def gram_counts(texts: DataFrame, langs: tuple[str, ...], orders=ORDERS, bits: int = BITS) -> np.ndarray:
    """Counts by model, family and bucket over ``texts`` (lang, text).

    Model k + 1 is that of ``langs[k]``; model 0 counts what is of no such language. Every
    task sends the nonzero buckets it met.
    """
    size = 1 << bits
    number = {x: k for k, x in enumerate(langs, 1)}

    def count(batches):
        table = np.zeros((len(langs) + 1, FAMILIES, size), np.int64)
        for batch in batches:
            by: dict[int, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    by.setdefault(number.get(lang, 0), []).append(text)
            for k, own in by.items():
                for family, bucket, _text in grams(own, orders, bits):
                    table[k, family] += np.bincount(bucket, minlength=size)
        flat = table.reshape(len(table), -1)
        model, at = np.nonzero(flat)
        yield pa.RecordBatch.from_pydict({"model": pa.array(model), "bucket": pa.array(at), "n": pa.array(flat[model, at])})

    out = np.zeros((len(langs) + 1, FAMILIES * size), np.int64)
    rows = texts.select(F.coalesce("lang", F.lit("")).alias("lang"), "text")
    found = rows.mapInArrow(count, "model long, bucket long, n long").groupBy("model", "bucket").agg(F.sum("n").alias("n")).toPandas()
    out[found["model"].to_numpy(np.int64), found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out.reshape(len(langs) + 1, FAMILIES, size)


def pooled(target: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tables with model 0 taken over all languages that have models, by their raw text.

    Without such a language it keeps its own counts.
    """
    target, raw = target.astype(np.float64), raw.astype(np.float64)
    if len(target) > 1:
        share = raw[1:].sum(axis=2, keepdims=True) / np.maximum(target[1:].sum(axis=2, keepdims=True), 1)
        total = target[1:].sum(axis=(0, 2)) / np.maximum((target[1:] * share).sum(axis=(0, 2)), 1e-300)
        target[0], raw[0] = (target[1:] * share).sum(axis=0) * total[:, None], raw[1:].sum(axis=0)
    return target, raw


def log_ratios(target: np.ndarray, raw: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """For each model, family and bucket, the log of its probability in the target over that in the raw text.

    Raw counts are scaled to the target's size before ``smoothing`` is added to both, so
    n-grams too rare for the target to show count for little.
    """
    n, m = target.sum(axis=2, keepdims=True), raw.sum(axis=2, keepdims=True)
    out = np.log(target + smoothing) - np.log(raw * (n / np.maximum(m, 1)) + smoothing)
    return np.where((n > 0) & (m > 0), out, 0.0)


def gumbel(ids: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Gumbel noise that follows from each id."""
    with np.errstate(over="ignore"):
        h = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0xD1B54A32D192ED03 % (1 << 64))
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(times)
        h ^= h >> np.uint64(31)
    u = ((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
    return -np.log(-np.log(u))


def order_key(x: np.ndarray) -> np.ndarray:
    """Longs in the order of the doubles ``x``."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits)


def text_ratios(texts: list[str], model: np.ndarray, table: np.ndarray, orders=ORDERS, bits: int = BITS, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The log importance ratio of every text under its model, and its number of words."""
    score, total = np.zeros((FAMILIES, len(texts))), np.zeros((FAMILIES, len(texts)))
    for family, bucket, text in grams(texts, orders, bits):
        score[family] += np.bincount(text, weights=table[model[text], family, bucket], minlength=len(texts))
        total[family] += np.bincount(text, minlength=len(texts))
    return (score / np.maximum(total, 1)).sum(axis=0) * np.minimum(total[1], length), total[1].astype(np.int64)


def scored(docs: DataFrame, table: np.ndarray, langs: tuple[str, ...], orders=ORDERS, bits: int = BITS, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """doc (all columns of ``docs`` in a struct), id, log_ratio, n_words and key (null without evidence)."""
    shared = docs.sparkSession.sparkContext.broadcast(table.astype(np.float32))
    number = {x: k for k, x in enumerate(langs, 1)}

    def run(batches):
        for batch in batches:
            ids = batch.column("id")
            texts = [t or "" for t in batch.column("text").to_pylist()]
            model = np.array([number.get(x, 0) for x in batch.column("lang").to_pylist()], np.int64)
            ratio, words = text_ratios(texts, model, shared.value, orders, bits, length)
            key = order_key(ratio + gumbel(ids.fill_null(0).to_numpy(zero_copy_only=False), seed))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), ids, pa.array(ratio), pa.array(words), pa.array(key, mask=words == 0)], names=["doc", "id", "log_ratio", "n_words", "key"])

    rows = docs.select(whole_row(docs).alias("doc"), F.col("doc_id").cast("long").alias("id"), F.coalesce("lang", F.lit("")).alias("lang"), "text")
    kind = T.StructType([rows.schema["doc"], *(T.StructField(n, t) for n, t in (("id", T.LongType()), ("log_ratio", T.DoubleType()), ("n_words", T.LongType()), ("key", T.LongType())))])
    return rows.mapInArrow(run, kind)


def kth_largest(keys: DataFrame, k: int) -> int | None:
    """The k-th largest of the column ``key`` (of at least k), by histograms of 16 bits at a time."""
    if k < 1:
        return None
    prefix, left = None, k
    for shift in (48, 32, 16, 0):
        part = F.shiftright("key", shift)
        rows = keys.where(F.shiftright("key", shift + 16) == prefix) if prefix is not None else keys.where("key is not null")
        for value, n in sorted(((r.part, r.n) for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()), reverse=True):
            prefix = value
            if n >= left:
                break
            left -= n
    return prefix


def logistic(x: np.ndarray, good: np.ndarray, bad: np.ndarray, ridge: float = 0.1) -> tuple[float, float]:
    """Slope and intercept of the curve through ``good`` and ``bad`` counts at ``x``, by Newton's method.

    ``ridge`` on the slope keeps it finite where the two don't overlap.
    """
    w = np.zeros(2)
    at = np.stack([x, np.ones_like(x)], axis=1)
    n = good + bad
    held = np.array([ridge, 1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(at @ w, -500, 500)))
        loss = at.T @ (good - n * p) - held * w
        step = np.linalg.solve((at * (n * p * (1 - p))[:, None]).T @ at + np.diag(held), loss)
        w += step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def expected_good(rows: DataFrame, labels: DataFrame, max_target: int = MAX_TARGET) -> int:
    """How many of ``rows`` (id, log_ratio, key) are expected to be good, by the labelled ones.

    All rows with evidence if there are no labels of one of the two kinds.
    """
    step = F.round(F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), "log_ratio")) * STEPS).cast("int").alias("step")
    known = rows.where("key is not null")
    all_ = {r.step: r.n for r in known.groupBy(step).agg(F.count("*").alias("n")).collect()}
    total = sum(all_.values())
    few = labelled(labels, max_target).select(F.col("label_id").alias("id"), "quality")
    seen = known.join(F.broadcast(few), "id").groupBy(step).agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") != 1).alias("bad")).orderBy("step").collect()
    good, bad = np.array([r.good for r in seen], float), np.array([r.bad for r in seen], float)
    if not good.sum() or not bad.sum():
        return total
    slope, base = logistic(np.array([r.step for r in seen]) / STEPS, good, bad)
    at = np.array(sorted(all_), float)
    odds = 1 / (1 + np.exp(-np.clip(slope * at / STEPS + base, -500, 500)))
    return round(float(odds @ np.array([all_[k] for k in sorted(all_)])))


def labelled(labels: DataFrame, max_target: int = MAX_TARGET) -> DataFrame:
    """label_id and quality of at most ``max_target`` labelled ids; of contrary labels of one id the lower counts."""
    ids = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.min("quality").alias("quality"))
    return ids.orderBy(F.xxhash64("label_id"), "label_id").limit(max_target)


def target_rows(docs: DataFrame, labels: DataFrame, max_target: int = MAX_TARGET) -> DataFrame:
    """lang (empty for null) and text of the documents that are labelled good (quality 1)."""
    good = labelled(labels, max_target).where("quality = 1").select("label_id")
    rows = docs.select(F.col("doc_id").cast("long").alias("label_id"), F.coalesce("lang", F.lit("")).alias("lang"), "text")
    return rows.join(F.broadcast(good), "label_id", "left_semi").select("lang", "text")


def resample(docs: DataFrame, labels: DataFrame, max_target: int = MAX_TARGET, length: int = LENGTH, seed: int = SEED, k: int | None = None) -> DataFrame:
    """doc (a struct of all columns), log_ratio, n_words, key and ``kept`` for every row.

    ``k`` texts are kept, by default the expected number of good ones.
    """
    target = target_rows(docs, labels, max_target)
    known = target.groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_TARGET)
    langs = tuple(r.lang for r in known.orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect())
    table = log_ratios(*pooled(gram_counts(target, langs), gram_counts(docs.select("lang", "text"), langs)))
    rows = durable(scored(docs, table, langs, length=length, seed=seed), "scores")
    least = kth_largest(rows.select("key"), expected_good(rows, labels, max_target) if k is None else k)
    kept = F.lit(False) if least is None else F.coalesce(F.col("key") >= least, F.lit(False))
    return rows.select("doc", "log_ratio", "n_words", "key", kept.alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    rows = resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rows.select("doc.doc_id", "log_ratio", "n_words", F.col("key").alias("sample_key"), "kept")


QUERIES = {"op9_quality_classifier": query}
ORACLE_SQL: dict[str, str] = {}
