import hashlib

import public_tokenizers
import pytest

import corpus_pipeline as P
from wayspark.functions import durable
from wayspark.llm import byte_bpe


@pytest.fixture(scope="module")
def steps(spark):
    sf = "/root/testdata/sf0.001"
    docs = [spark.read.parquet(f"{sf}/documents.parquet")]
    for name, stage in P.STAGES:
        docs.append(durable.durable(stage(spark, docs[-1], sf), name.replace(" ", "-")))
    return docs


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages_keep_the_columns_and_only_take_rows_away(steps):
    for before, after in zip(steps[:-2], steps[1:-1]):
        assert after.columns == steps[0].columns and ids(after) <= ids(before)
    assert ids(steps[4]) == ids(steps[3]) and ids(steps[5]) == ids(steps[4])


def test_junk_goes_and_clean_documents_stay(spark, steps):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    good, bad = ({i for i in ids(steps[0]) if labels.get(i) == q} for q in (1, 0))
    assert len(good & ids(steps[1])) >= 0.97 * len(good) and len(bad & ids(steps[1])) <= 0.3 * len(bad)


def test_tokens_come_in_the_order_of_the_mix(steps):
    encoder = byte_bpe.Encoder(public_tokenizers.path(byte_bpe.VOCABULARY), public_tokenizers.PATTERN)
    texts = {r.doc_id: r.text for r in steps[4].collect()}
    rows = steps[5].collect()
    assert len({(r.shard, r.row) for r in rows}) == len(rows)
    for r in rows:
        assert r.ids == encoder.ids(texts[r.doc_id]).tolist() and r.n_tokens == len(r.ids)
        assert r.text_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_tokens_of_rows_without_files(make_docs):
    docs = make_docs(["a b", None])
    assert {(r.shard, r.row) for r in P.tokens(docs.sparkSession, docs, "").collect()} == {(None, None)}


def test_empty_table(make_docs, spark):
    docs = make_docs([])
    for _, stage in P.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert docs.count() == 0


def test_odd_rows_and_names(spark, make_docs, odd):
    """Null, empty and long texts, repeated rows and ids, and columns of any name pass every stage."""
    docs = make_docs([*enumerate(odd), (None, "one", None, None), (3, "one", None, None), (3, "one", None, None)])
    docs = docs.selectExpr("*", "1 as `a.b`", "2 as `my col`", "3 as `my-col`", "4 as `x``y`", "5 as uid", "6 as doc", "7 as place")
    for _, stage in P.STAGES[1:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
    kept = P.quality(spark, docs, "/root/testdata/sf0.001")
    assert kept.columns == docs.columns and kept.where("text is null or trim(text) = ''").count() == 0
    assert P.tokens(spark, docs, "").count() == docs.count()
