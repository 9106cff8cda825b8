"""Operator 5, language ID: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams by language in every task and adds the tables up; the model is a
matrix of log-probabilities, one row for a language, whose size is checked before it is
broadcast. Prediction sums its columns over the n-grams of a text, batch by batch.

Edge cases: a text that is null or has no letter is ``und`` with score 0. Rows without
doc_id or language are never learned from. Without any row to learn from, every text is
``und``. Ties go to the language that sorts first. Long texts are scored in pieces, each
n-gram once.
Other columns are ignored, repeated rows count each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayspark.llm.text_arrays import PIECE, gram_buckets, pieces

ORDERS = (1, 2, 3)
BITS = 14
SMOOTHING = 0.5
#: The matrix that is broadcast may take this much.
MAX_MODEL_BYTES = 64 << 20
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, mod 5, is 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    log_prior: np.ndarray
    log_prob: np.ndarray  # languages x buckets
    orders: tuple[int, ...]
    bits: int

    def scores(self, texts: list[str], size: int = PIECE) -> np.ndarray:
        """Log-probability of each language and text, texts x languages."""
        out = np.tile(self.log_prior, (len(texts), 1))
        for piece in pieces([t.lower() for t in texts], max(self.orders) - 1, size):
            for bucket, text in gram_buckets(piece, self.orders, self.bits):
                for k in range(len(self.langs)):
                    out[:, k] += np.bincount(text, weights=self.log_prob[k][bucket], minlength=len(texts))
        return out


def train(docs: DataFrame, orders=ORDERS, bits: int = BITS, smoothing: float = SMOOTHING, max_bytes: int = MAX_MODEL_BYTES) -> Model:
    """Fit on all rows of ``docs`` (text, lang) that have a language and a text.

    What reaches the driver is languages x 2**bits counts, at most ``max_bytes``;
    ValueError if the languages would make it larger.
    """
    rows = docs.where("lang is not null and text is not null").select("lang", "text")
    size = 1 << bits

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        texts_of: dict[str, int] = {}
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for lang in set(langs):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                table = totals.setdefault(lang, np.zeros(size + 1, dtype=np.int64))
                texts_of[lang] = texts_of.get(lang, 0) + len(own)
                for piece in pieces([t.lower() for t in own], max(orders) - 1):
                    for bucket, _text in gram_buckets(piece, orders, bits):
                        table[:size] += np.bincount(bucket, minlength=size)
        for lang, table in totals.items():
            table[size] = texts_of[lang]
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at)), "bucket": pa.array(at), "n": pa.array(table[at])})

    counts = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    langs = tuple(sorted(r[0] for r in rows.select("lang").distinct().limit(max_bytes // (8 * size) + 1).collect()))
    if len(langs) * size * 8 > max_bytes:
        raise ValueError(f"a model of more than {max_bytes // (8 * size)} languages exceeds max_bytes")
    table = np.zeros((len(langs), size + 1))
    found = counts.toPandas()
    if len(found):
        table[np.searchsorted(langs, found["lang"].to_numpy(dtype=str)), found["bucket"].to_numpy()] = found["n"].to_numpy()
    grams = table[:, :size] + smoothing
    return Model(
        langs, np.log(np.maximum(table[:, size], 1) / max(table[:, size].sum(), 1)),
        np.log(grams / grams.sum(axis=1, keepdims=True)), tuple(orders), bits,
    )


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score (posterior of the language, from 0 to 1).

    Overlapping n-grams repeat the same evidence, so the posterior takes the mean over
    the orders of their log-probabilities.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if m.langs and _LETTER.search(t)]
            if known:
                s = m.scores([texts[i] for i in known])
                best = s.argmax(axis=1)
                p = 1 / np.exp((s - s.max(axis=1, keepdims=True)) / len(m.orders)).sum(axis=1)
                for i, k, x in zip(known, best, p, strict=True):
                    pred[i], score[i] = m.langs[k], x
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(pred, pa.string()), pa.array(score)],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    return cols.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, train(docs.where(~held_out(F.col("doc_id")))))


QUERIES = {"op5_language_id": query}
ORACLE_SQL: dict[str, str] = {}
