"""Vocabularies, encoders and encoded lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse, strip
from .order import numbered

#: The token of unknown ones, with id 0.
UNKNOWN = "<UNK>"


def vocabulary(df: DataFrame, column: str, min_freq: int = 1) -> DataFrame:
    """token, count of the non-blank trimmed tokens of a list column."""
    tokens = df.select(F.explode(column).alias("token")).select(strip(F.col("token")).alias("token")).where("token <> ''")
    return tokens.groupBy("token").agg(F.count("*").alias("count")).where(F.col("count") >= min_freq)


def fit_encoder(df: DataFrame, column: str, row_key: list[str], min_freq: int = 1) -> DataFrame:
    """id, token, count: lower-cased tokens numbered from 1 in order of first appearance by row key and place."""
    tokens = df.select(*row_key, F.posexplode(column).alias("pos", "token")).withColumn("token", F.lower(strip(F.col("token")))).where("token <> ''")
    seen = tokens.groupBy("token").agg(F.count("*").alias("count"), F.min(F.struct(*row_key, "pos")).alias("first")).where(F.col("count") >= min_freq)
    return numbered(seen, [F.col("first")], "id").select("id", "token", "count")


def encode_lists(df: DataFrame, column: str, encoder: DataFrame, row_key: list[str], out: str = "ids", empty_as_unknown: bool = False, any_case: bool = True, most_sent: int = 256) -> DataFrame:
    """df with the ids of a list column's tokens in order; unknown tokens are 0.

    any_case: look tokens up in lower case; else as they are and then with
    single blanks.  A very small encoder is sent along as one map (Spark looks maps
    up entry by entry), a larger one is joined.
    """
    forms = (lambda t: [F.lower(strip(t))]) if any_case else (lambda t: [t, collapse(t)])
    zero = F.lit(0).cast("bigint")
    if encoder.limit(most_sent + 1).count() <= most_sent:
        table = F.broadcast(encoder.agg(F.map_from_entries(F.collect_list(F.struct("token", F.col("id").cast("bigint")))).alias("__map")))
        ids = F.transform(F.col(column), lambda t: F.coalesce(*[F.try_element_at(F.col("__map"), f) for f in forms(t)], zero))
        result = df.crossJoin(table).withColumn(out, ids).drop("__map")  # one row on the right
    else:
        tokens = df.select(*row_key, F.posexplode_outer(column).alias("__pos", "__token"))
        for i in range(len(forms(F.col("__token")))):
            side = encoder.select(F.col("token").alias(f"__t{i}"), F.col("id").cast("bigint").alias(f"__id{i}"))
            tokens = tokens.join(side, forms(F.col("__token"))[i] == F.col(f"__t{i}"), "left")
        found = F.coalesce(*[F.col(f"__id{i}") for i in range(len(forms(F.col("__token"))))], zero)
        lists = tokens.groupBy(*row_key).agg(F.array_sort(F.collect_list(F.when(F.col("__pos").isNotNull(), F.struct("__pos", found.alias("i"))))).alias("__l"))
        result = df.join(lists.select(*row_key, F.col("__l.i").alias(out)), row_key, "left")
    ids = F.coalesce(F.col(out), F.array().cast("array<bigint>"))
    return result.withColumn(out, F.when(F.size(ids) == 0, F.array(zero)).otherwise(ids) if empty_as_unknown else ids)


def encode_counters(df: DataFrame, ids: str) -> DataFrame:
    """rows, tokens, unknown of a column of id lists."""
    return df.agg(F.count("*").alias("rows"), F.sum(F.size(ids)).cast("bigint").alias("tokens"), F.sum(F.size(F.filter(ids, lambda x: x == 0))).cast("bigint").alias("unknown"))


def probe(df: DataFrame, column: str) -> DataFrame:
    """rows, filled, distinct: rows of a list column, those with an item, and distinct lists."""
    return df.agg(F.count("*").alias("rows"), F.count_if(F.size(column) > 0).alias("filled"), F.countDistinct(column).alias("distinct"))


def encoded_dataset(df: DataFrame, column: str, encoder: DataFrame, row_key: list[str], dataset_id: int) -> DataFrame:
    """Dataset ID, Index (from 0, in order of the row key), Ingredients: a list column as ids; empty lists are the unknown id alone."""
    ids = encode_lists(df.select(*row_key, column), column, encoder, row_key, out="Ingredients", empty_as_unknown=True)
    rows = numbered(ids, list(map(F.col, row_key)), "Index", 0)
    return rows.select(F.lit(dataset_id).cast("int").alias("Dataset ID"), F.col("Index").cast("bigint").alias("Index"), "Ingredients")
