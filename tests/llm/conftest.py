import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents from (doc_id, text[, lang[, source]]) rows."""

    def make(rows):
        return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0", len(r[1] or "")) for r in rows], DOCUMENTS)

    return make


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


#: Nulls, empty, white space only, one word, a very long text, ties and repeats.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "a b c d e " * 30_000), (6, "same text here for two"), (7, "same text here for two"), (8, "Ünïcödé 🙂 日本語 text"), (None, "no id at all here"), (9, "x" * 200_000)]
