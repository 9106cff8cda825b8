import hashlib

import numpy as np
from pyspark.sql import functions as F

from wayspark.llm import warc as M

PAGES = "page_id long, url string, html string"
INNER = M.MAGIC + "WARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def round_trip(spark, rows, path, chunk=M.CHUNK, parts=2, extra=False):
    pages = spark.createDataFrame(rows, PAGES).repartition(parts)
    M.write_warc(pages.withColumn("digest", F.lit(1)) if extra else pages, path)
    return M.read_warc(spark, path, chunk).collect()


def test_magic_in_payloads_is_no_record(spark, tmp_path):
    html = ["plain", "x" + M.MAGIC + "y", INNER, INNER * 30 + "tail", M.MAGIC, M.MAGIC[:-1], "\r\n\r\n", "é" * 700, "", None]
    rows = [(i, f"http://a/{i}\r\nWARC-Type: x", h) for i, h in enumerate(html)]
    for n, chunk in enumerate((64, 1000, M.CHUNK)):
        got = {r.page_id: r for r in round_trip(spark, rows, str(tmp_path / str(n)), chunk)}
        assert len(got) == len(rows)
        for i, h in enumerate(html):
            raw = (h or "").encode()
            assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].digest_ok) == (len(raw), hashlib.sha1(raw).hexdigest(), "response", True)


def test_revisits(spark, tmp_path):
    rows = [(1, "u", "a" * 1000), (5, "u", "a" * 1000), (3, "u", "a" * 1000), (4, "u", "b" * 999), (6, "u", "b" * 999), (None, "u", "a" * 1000), (None, None, "c" * 2000)]
    got = round_trip(spark, rows, str(tmp_path / "w"), extra=True)
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in got)
    assert kinds == [(0, "response", None, 2000), (0, "revisit", 5, 1000), (1, "revisit", 5, 1000), (3, "revisit", 5, 1000), (4, "response", None, 999), (5, "response", None, 1000), (6, "response", None, 999)]
    assert len({r.payload_digest for r in got if r.payload_bytes == 1000}) == 1


def test_many_records_over_many_chunks(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"page {i} " * (i % 40)) for i in range(500)]
    got = round_trip(spark, rows, str(tmp_path / "w"), 2000, 1)
    assert sorted(r.page_id for r in got) == list(range(500)) and all(r.digest_ok for r in got)


def test_a_broken_chain_ends_there(spark, tmp_path):
    record = lambda i, body: f"{M.MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n"
    (tmp_path / "a.warc").write_bytes((record(1, "one") + record(2, "two") + "damage" + record(3, "three")).encode())
    (tmp_path / "b.warc").write_bytes(b"junk" + record(4, "four").encode())
    (tmp_path / "c.warc").write_bytes(record(5, "\r\n\r\n").encode())
    assert sorted(r.page_id for r in M.read_warc(spark, str(tmp_path)).collect()) == [1, 2, 5]


def test_empty_table(spark, tmp_path):
    assert round_trip(spark, [], str(tmp_path / "w")) == []


def test_exits():
    offset, after = np.array([0, 10, 25, 90]), np.array([10, 25, 130, 95])
    assert M.exits(offset, after, 100).tolist() == [130, 130, 130, -1]


def test_reading_in_small_splits(spark, tmp_path):
    """Splits of Spark's text source end anywhere: in a magic line, a header or a payload."""
    rows = [(i, f"http://h/{i}", f"page {i} é " * (i % 60) + (INNER if i % 9 == 0 else "")) for i in range(300)]
    M.write_warc(spark.createDataFrame(rows, PAGES).coalesce(1), str(tmp_path / "w"))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for split in (700, 1001, 4099):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
            got = {r.page_id: r for r in M.read_warc(spark, str(tmp_path / "w"), 5000).collect()}
            assert all(got[i].payload_digest == hashlib.sha1(h.encode()).hexdigest() for i, _, h in rows) and len(got) == 300
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
