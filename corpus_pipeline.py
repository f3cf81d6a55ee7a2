"""A training corpus from raw documents: five stages, each on all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet to the shared folder and read again as the next stage's docs.  All but
the last return the columns of documents.  What a stage and its predecessor
wrote on the way is deleted once its result is written.

Every stage takes null, empty and very long texts, rows without a doc_id,
repeated rows, extra columns of any name and an empty table (empty result);
what it does with them its docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagloom.llm import mixing, near_dedup, packing, quality, toxicity
from tagloom.llm.common import read, staged
from tagloom.llm.tokenization import public
from tagloom.storage import drop_staged, staged_tables


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts: a score of 0.5 or more.

    Null and empty texts are scored like any other; repeated rows and rows
    without a doc_id are judged each.  Without labels every document has the
    score 0.5 and stays.
    """
    return quality.accepted(docs, read(spark, sf_dir, "labels"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic: a score below 0.5.

    Null texts and texts without a letter have the score of a text without
    match; repeated rows and rows without a doc_id are judged each.  Where the
    labels teach no term, as without labels, all documents stay.
    """
    return toxicity.accepted(docs, read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the one with the smallest doc_id.

    Texts without words link with nothing and stay; so do rows without a doc_id.
    Of rows equal in doc_id and text one stays.
    """
    return near_dedup.kept_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources in their target shares; a document taken twice is two rows.

    Null sources are one source.  Documents without words aren't taken.  Equal
    rows count each, so as many come out as the mix takes.
    """
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences of 4096 tokens.

    Null and empty texts are the end id alone; longer ones are cut into pieces.
    Rows that repeat a document are packed each.
    """
    return packing.pack(docs, public("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Classifiers and tokenizers can't be expressed in SQL; a test compares run() with a brute-force version of every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    first = staged_tables()
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
        drop_staged(since=first, but_last=True)
    return docs
