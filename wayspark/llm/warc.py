"""Operator 7, WARC archives: writing, and reading with a check of the chain of records.

Spark's text source writes the records and cuts the files at every occurrence of the
magic line, so archives are read in splits. A task can't tell a record from a magic line
inside a payload: it emits every occurrence as a candidate with the offset at which the
next record would have to be, by its own length. Offsets follow from the sizes of the
pieces. A file's records are the candidates that the chain from its start reaches: within
a chunk of CHUNK bytes a task follows the pointers, between chunks they are doubled round
by round. Payloads that hold the magic line come in several pieces, put together again.

Edge cases: a null html is an empty payload, a null page_id an empty id (read back as
null); line ends in urls are percent-encoded. Payloads of at least ``min_bytes`` that are
equal are stored once, with the largest page_id (rows that repeat it are stored each);
without any page_id all are stored. A chain that breaks off (cut or damaged file) ends
there: what it reached stays. Other columns are ignored; an empty table makes an archive
without records.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wayspark.functions.durable import durable, new_path

VERSION = "WARC/1.1"
MAGIC = VERSION + "\r\n"
END = "\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"
MIN_BYTES = 1000
#: Bytes of a file within which one task follows the chain.
CHUNK = 1 << 20
#: Groups of equal payloads that are broadcast; more are joined by a shuffle.
MAX_BROADCAST = 50_000


def marked(pages: DataFrame, min_bytes: int = MIN_BYTES, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """page_id, url, payload, payload_bytes, digest, record_type, refers_to for every row."""
    payload = F.coalesce(pages["html"], F.lit(""))
    rows = pages.select(
        pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"), payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload.cast("binary")).alias("digest"),
    )
    groups = durable(
        rows.where(F.col("payload_bytes") >= min_bytes).groupBy("digest", "payload_bytes").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"),
        "payloads",
    )
    small = groups.count() <= max_broadcast
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(F.broadcast(groups) if small else groups, ["digest", "payload_bytes"], "left").select(
        "page_id", "url", "payload", "payload_bytes", "digest",
        F.when(refers.isNotNull(), "revisit").otherwise("response").alias("record_type"), refers.alias("refers_to"),
    )


def _id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def record_text(rows: DataFrame) -> DataFrame:
    """``value``: each record from its magic line to the end of its block."""
    url = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    size = F.col("payload_bytes").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit(END))
    block = F.concat(http, F.when(F.col("record_type") == "response", F.col("payload")).otherwise(""))
    fields = [
        ("WARC-Type", F.col("record_type")), ("WARC-Record-ID", _id(F.col("page_id"))), ("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), ("X-Payload-Length", size),
        ("Content-Type", F.lit("application/http; msgtype=response")), ("Content-Length", F.octet_length(block).cast("string")),
    ]
    head = F.concat(*(x for name, value in fields for x in (F.lit(f"{name}: "), value, F.lit("\r\n"))))
    refers = F.when(
        F.col("record_type") == "revisit",
        F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), _id(F.col("refers_to")), F.lit("\r\n")),
    ).otherwise("")
    return rows.select(F.concat(F.lit(MAGIC), refers, head, F.lit("\r\n"), block).alias("value"))


def write_warc(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES) -> None:
    """One archive for each partition of ``pages`` under ``path``."""
    record_text(marked(pages, min_bytes)).write.option("lineSep", END).text(path)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, split, number, content (bytes): what lies between magic lines, in file order."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("number"), F.col("value").cast("binary").alias("content"),
    )


_FIELD = re.compile(rb"^([!-9;-~]+):[ \t]*(.*?)[ \t]*\r?$", re.M)
_PAGE = re.compile(rb"<urn:page:(-?\d+)>")
FIELDS = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, digest_ok boolean"


def parse(content: bytes, whole: bool) -> tuple:
    """(bytes from the magic line's end to the next record, or None; the values of FIELDS).

    Without the ``whole`` record its payload isn't looked at.
    """
    at = content.find(END.encode())
    fields = {k.lower(): v for k, v in _FIELD.findall(content[:at])} if at >= 0 else {}
    length = fields.get(b"content-length", b"")
    if not length.isdigit() or b"warc-type" not in fields:
        return (None,) * 7
    size = int(length)
    kind = fields[b"warc-type"].decode("utf-8", "replace")
    page, refers = (_PAGE.match(fields.get(k, b"")) for k in (b"warc-record-id", b"warc-refers-to"))
    named = fields.get(b"warc-payload-digest", b"").decode("utf-8", "replace").removeprefix("sha1:").lower() or None
    stored = fields.get(b"x-payload-length", b"")
    n, digest, ok = int(stored) if stored.isdigit() else None, named, None
    end = at + len(END) + size
    if kind == "response" and (whole or end <= len(content)):
        block = content[at + len(END) : end]
        start = block.find(END.encode()) + len(END) if block.startswith(b"HTTP/") else 0
        n, digest = len(block) - start, hashlib.sha1(block[start:]).hexdigest()
        ok = named is None or named == digest
    return end + len(END), int(page[1]) if page else None, kind, int(refers[1]) if refers else None, n, digest, ok


def _with_offsets(found: DataFrame) -> DataFrame:
    """``offset``, at which a piece's magic line begins; ``size`` is that of its content."""
    ahead = F.col("size") + len(MAGIC)
    within = W.partitionBy("file", "split").orderBy("number")
    splits = found.groupBy("file", "split").agg(F.sum(ahead).alias("bytes"))
    starts = splits.select("file", "split", (F.sum("bytes").over(W.partitionBy("file").orderBy("split")) - F.col("bytes")).alias("start"))
    return (
        found.withColumn("local", F.sum(ahead).over(within) - ahead).join(starts, ["file", "split"])
        .withColumn("offset", F.col("start") + F.col("local") - len(MAGIC)).drop("split", "number", "local", "start")
    )


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every magic line: file, offset, size, next (null: no record) and FIELDS."""

    def run(batches):
        for batch in batches:
            content = batch.column("content")
            rows = [(len(c), *parse(c, False)) for c in (x.as_py() for x in content)]
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("file", "split", "number")), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    names = ["file", "split", "number", "size", "ahead", "page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "digest_ok"]
    found = durable(pieces(spark, path).mapInArrow(run, f"file string, split long, number long, size long, ahead long, {FIELDS}"), "pieces")
    return _with_offsets(found).where("offset >= 0").withColumn("next", F.col("offset") + len(MAGIC) + F.col("ahead")).drop("ahead")


def exits(offset: np.ndarray, after: np.ndarray, chunk: int) -> np.ndarray:
    """Where the chain from each offset (ascending, of one chunk) leaves the chunk; -1: nowhere."""
    out = np.full(len(offset), -1, np.int64)
    at = np.searchsorted(offset, after)
    for i in range(len(offset) - 1, -1, -1):
        if after[i] >= 0:
            if after[i] // chunk != offset[i] // chunk:
                out[i] = after[i]
            elif at[i] < len(offset) and offset[at[i]] == after[i]:
                out[i] = out[at[i]]
    return out


def _chunked(batch) -> list[tuple[int, pa.StructArray, np.ndarray, np.ndarray]]:
    out = []
    for i, rows in enumerate(batch.column("rows")):
        held = rows.values
        out.append((i, held, held.field("offset").to_numpy(), held.field("next").fill_null(-1).to_numpy()))
    return out


def chained(found: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The rows of ``found`` (candidates) that the chain from the start of their file reaches."""
    columns = ["offset", *(c for c in found.columns if c not in ("file", "offset"))]
    chunks = durable(
        found.groupBy("file", F.floor(F.col("offset") / chunk).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("rows")), "chunks"
    )

    def leave(batches):
        for batch in batches:
            file, offset, to = [], [], []
            for i, _, at, after in _chunked(batch):
                out = exits(at, after, chunk)
                file += [batch.column("file")[i].as_py()] * len(at)
                offset.append(at)
                to.append(out)
            yield pa.RecordBatch.from_arrays([pa.array(file, pa.string()), *(pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (offset, to))], names=["file", "offset", "to"])

    jumps = chunks.mapInArrow(leave, "file string, offset long, to long")
    jumps = durable(jumps, "exits")
    entries = jumps.where("to >= 0").select("file", F.col("to").alias("offset")).unionByName(jumps.select("file", F.lit(0).cast("long").alias("offset"))).distinct()
    jumps = durable(jumps.join(entries, ["file", "offset"], "left_semi"), "jumps")
    reached = durable(jumps.where("offset = 0").select("file", "offset"), "reached")
    n = reached.count()
    while n:
        step = jumps.select("file", "offset", F.col("to"))
        more = durable(reached.unionByName(reached.join(step, ["file", "offset"]).where("to >= 0").select("file", F.col("to").alias("offset"))).distinct(), "reached")
        after = more.count()
        if after == n:
            break
        onward = jumps.select("file", F.col("offset").alias("to"), F.col("to").alias("further"))
        jumps = durable(jumps.where("to >= 0").join(onward, ["file", "to"]).select("file", "offset", F.col("further").alias("to")), "jumps")
        reached, n = more, after

    def walk(batches):
        for batch in batches:
            for i, held, at, after in _chunked(batch):
                hit = np.zeros(len(at), bool)
                to = np.searchsorted(at, after)
                for entry in batch.column("entries")[i].as_py():
                    k = int(np.searchsorted(at, entry))
                    while k < len(at) and at[k] == entry and not hit[k]:
                        hit[k] = True
                        entry, k = after[k], int(to[k])
                keep = held.filter(pa.array(hit))
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("file")[i].as_py()] * len(keep), pa.string()), *keep.flatten()], names=["file", *columns])

    by_chunk = reached.groupBy("file", F.floor(F.col("offset") / chunk).alias("chunk")).agg(F.collect_list("offset").alias("entries"))
    return chunks.join(by_chunk, ["file", "chunk"]).mapInArrow(walk, found.select("file", *columns).schema).where("next is not null")


def read_warc(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """file, offset and FIELDS of every record; ``digest_ok`` is null where no payload is stored."""
    found = durable(candidates(spark, path), "candidates")
    records = durable(chained(found, chunk).withColumn("cut", F.col("next") > F.col("offset") + len(MAGIC) + F.col("size") + len(MAGIC)), "records")
    names = [c.split()[0] for c in FIELDS.split(", ")]
    whole = records.where("not cut").select("file", "offset", *names)
    cut = records.where("cut").select("file", "offset", "next")
    if cut.isEmpty():
        return whole
    parts = _with_offsets(pieces(spark, path).join(F.broadcast(cut.select("file").distinct()) if cut.count() <= MAX_BROADCAST else cut.select("file").distinct(), "file", "left_semi").withColumn("size", F.octet_length("content").cast("long")))
    # records don't overlap, so a piece belongs to the last that begins at or before it
    starts = records.select("file", "offset", F.when(F.col("cut"), F.col("offset")).alias("record"), F.col("next").alias("until"))
    owned = found.select("file", "offset").join(starts, ["file", "offset"], "left").withColumn("band", F.floor(F.col("offset") / chunk))
    long_ = durable(cut.withColumn("band", F.explode(F.sequence(F.floor(F.col("offset") / chunk), F.floor(F.col("next") / chunk)))), "cut")
    owner = owned.join(long_.select("file", "band", F.col("offset").alias("owner"), F.col("next").alias("stop")), ["file", "band"]).where((F.col("offset") >= F.col("owner")) & (F.col("offset") < F.col("stop")))
    joined = parts.join(owner.select("file", "offset", "owner"), ["file", "offset"]).groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("offset", "content"))).alias("parts"))

    def assemble(batches):
        for batch in batches:
            rows = [parse(MAGIC.encode().join(p["content"] for p in x.as_py()), True)[1:] for x in batch.column("parts")]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("owner"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["file", "offset", *names])

    return whole.unionByName(joined.mapInArrow(assemble, f"file string, offset long, {FIELDS}"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
with p as (select page_id, octet_length(encode(coalesce(html, '')))::BIGINT as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
m as (select *, max(page_id) over (partition by payload_digest, payload_bytes) as first from p)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= {MIN_BYTES} and page_id <> first then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= {MIN_BYTES} and page_id <> first then first end as refers_to
from m
"""

QUERIES = {"op7_warc": query}
ORACLE_SQL = {"op7_warc": ORACLE}
