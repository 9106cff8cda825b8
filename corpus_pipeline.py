"""Documents to token ids: five stages, each written as Parquet and read by the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``, whatever their names.

Any column may hold nulls. A null or blank text is no good text, so the first stage drops
it; the later stages take such texts all the same. Rows with equal doc_ids are separate
documents until the near-dedup, which goes by their texts. An empty table passes all stages.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayspark.functions.durable import durable, release
from wayspark.llm.byte_bpe import encode_and_decode
from wayspark.llm.columns import named
from wayspark.llm.importance import resample
from wayspark.llm.line_dedup import line_dedup
from wayspark.llm.mixing import mixed
from wayspark.llm.near_copies import one_of_each


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps.

    Texts that are null, empty or blank go; repeated rows share their fate, and so do rows
    whose sampling keys tie. Without labels all others stay.
    """
    return resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("kept").select("doc.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of repeated line runs; those that lose all words go.

    The first copy by doc_id stays (of equal ids, one of them; a null id is last). Null, empty
    and blank texts stay as they are.
    """
    left = line_dedup(docs).where("has_words or n_removed = 0")
    own = {"text": F.col("left"), "n_chars": F.length("left").cast("long")}
    return left.select(*(own.get(c, named(c, "doc")).alias(c) for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id.

    Null, empty and blank texts are copies of each other; of repeated rows one stays, and one
    without id only if its whole group has none.
    """
    return one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix: over the files by name, and within each file.

    A null source is a source of its own; no row gets lost, repeated ones have places of their own.
    """
    return mixed(docs).repartitionByRange("place").sortWithinPartitions("place").select("doc.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with the file (``shard``) and the row in it that the mix gave a document.

    ``text_sha256`` is of the decoded bytes. Without files, shard and row are null. A null or
    empty text has no tokens.
    """
    place = {"shard": F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).try_cast("int"), "row": F.col("_metadata.row_index")}
    try:
        placed = docs.select("doc_id", "text", *(c.alias(n) for n, c in place.items()))
    except AnalysisException:
        placed = docs.select("doc_id", "text", F.lit(None).cast("int").alias("shard"), F.lit(None).cast("long").alias("row"))
    return encode_and_decode(placed, keep=("shard", "row")).select(
        "doc_id", "shard", "row", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("content", 256).alias("text_sha256")
    )


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("near-dedup", near_copies),
    ("mixing", mix),
    ("byte-level BPE", tokens),
]

#: Several stages have no SQL; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; a stage's rows are deleted once the next is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        after = durable(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(docs)
        docs = after
    return docs
