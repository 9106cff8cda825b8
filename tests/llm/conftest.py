import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture
def make_docs(spark):
    """documents from texts, or from (doc_id, text[, lang, source])."""

    def make(rows, parts=3):
        full = []
        for i, r in enumerate(rows):
            r = (i, r) if not isinstance(r, tuple) else r
            r = (*r, *("en", "s")[len(r) - 2 :]) if len(r) < 4 else r
            full.append((*r[:4], None if r[1] is None else len(r[1])))
        return spark.createDataFrame(full, DOCS).repartition(parts)

    return make


#: Null, empty, blank, tie, repeat, long and odd texts.
ODD = [None, "", " \n\t\n", "one", "one", "two words", "é ß 日本 \U0001f600", "x" * 5000, "word " * 3000, "a\nb\na\nb", "no letters 123 !!", "\r\n"]


@pytest.fixture
def odd():
    return list(ODD)
