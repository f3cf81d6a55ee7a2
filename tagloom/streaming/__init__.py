"""Structured Streaming: the stateless token pipelines and windowed counts over unbounded sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tokens as T


def mapped_tokens(stream: DataFrame, column: str, mapping: DataFrame, out: str = "name") -> DataFrame:
    """A stream with the token pipeline applied to a token column; the dictionary (key, value) is a static side."""
    side = lambda k, v: mapping.select(F.col("key").alias(k), F.col("value").alias(v))
    df = stream.join(side("__k1", "__v1"), F.lower(F.col(column)) == F.col("__k1"), "left").withColumn("__x", T.first_pass(F.coalesce("__v1", column)))
    df = df.join(side("__k2", "__v2"), F.lower(F.col("__x")) == F.col("__k2"), "left").withColumn(out, T.last_pass(F.coalesce("__v2", "__x")))
    return df.drop("__k1", "__v1", "__k2", "__v2", "__x")


def windowed_counts(stream: DataFrame, time: str, item: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts of items in event-time windows; rows later than `late` are dropped and windows then closed."""
    rows = stream.withWatermark(time, late).groupBy(F.window(time, window), item).agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), item, "n")


def run_to_table(result: DataFrame, path: str, state: str) -> None:
    """Runs an aggregated stream over all that is there; each batch replaces the Parquet table with the whole result, written by the tasks."""

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    run = result.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", state).trigger(availableNow=True).start()
    run.awaitTermination()
