"""Extra columns with the names that operators use inside, and null values in every column."""

import pytest
from pyspark.sql import functions as F

from tagloom.llm import embed_dedup, fingerprint, langid, mixing, near_dedup, packing, quality, sharding, token_store, toxicity
from tagloom.llm.tokenization import public

NAMES = ("id", "n", "k", "v", "a", "b", "x", "y", "part", "size", "taken", "slot", "rank", "key", "head", "held_out", "score", "piece", "start", "length", "band", "rid", "label", "component", "bucket", "target", "vec", "count")


@pytest.fixture(scope="module")
def wide(make_docs):
    docs = make_docs([(i, f"some words stand here number {i % 4} and go on", None if i % 3 else "en", None if i % 5 else "s") for i in range(30)] + [(None, None, None, None)])
    return docs.withColumns({n: F.lit(n) for n in NAMES})


OPERATORS = {
    "near_dedup": lambda d, labels: near_dedup.dedup(d),
    "fingerprint": lambda d, labels: fingerprint.edited_against_next(d),
    "token_store": lambda d, labels: token_store.scan(token_store.write(d, public("byte_bpe_50k.json"))),
    "mixing": lambda d, labels: mixing.mix(d),
    "quality": quality.score,
    "packing": lambda d, labels: packing.pack(d, public("word_bpe_49k.json")),
    "toxicity": toxicity.score,
    "langid": lambda d, labels: langid.predict(d),
    "sharding": lambda d, labels: sharding.place(d, "doc_id", ["p", "q"], 101),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns(spark, wide, name):
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0, "t") for i in range(30)], "doc_id bigint, quality int, toxic boolean, text string").withColumn("toxic", F.col("toxic").cast("int"))
    assert OPERATORS[name](wide, labels).count() == 31


@pytest.mark.parametrize("stage", [lambda d, labels: quality.accepted(d, labels), lambda d, labels: toxicity.accepted(d, labels), lambda d, labels: near_dedup.kept_documents(d), lambda d, labels: mixing.mixed_documents(d)])
def test_stages_return_the_columns_of_their_input(spark, wide, stage):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id bigint, quality int, toxic int")
    assert stage(wide, labels).columns == wide.columns
    assert stage(wide, labels).count() >= 1


def test_clashing_columns_of_embeddings(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0)], "vec_id bigint, embedding array<float>, label int").withColumns({n: F.lit(n) for n in NAMES if n != "label"})
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embed_dedup.dedup(rows).collect()) == [(1, 1, 1), (2, 1, 1)]
