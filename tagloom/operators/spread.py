"""Joins on keys of which one may have a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than 1/HEAVY of a table's rows is dealt over several tasks; a table has fewer than HEAVY such keys, so their list may be broadcast.
HEAVY = 4096
#: Rows of a key that one task can take whatever the table's size.
LIGHT = 256


def pieces_of(n: Column, rows: int) -> Column:
    """Into how many pieces a key with n of a table's rows is split."""
    return F.ceil(n / F.lit(max(LIGHT, rows // HEAVY))).cast("int")


def heavy_keys(rows: DataFrame, key: str) -> list[tuple]:
    """(key, pieces) of the heavy keys of a written table: fewer than HEAVY."""
    total = rows.count()
    if total <= LIGHT:
        return []
    found = rows.groupBy(key).agg(F.count("*").alias("n")).withColumn("pieces", pieces_of(F.col("n"), total)).where("pieces > 1")
    return [(r[0], r[1]) for r in found.select(key, "pieces").collect()]


def spread_join(many: DataFrame, one: DataFrame, key: str, by: str, heavy: list[tuple] | None = None, how: str = "inner") -> DataFrame:
    """many.join(one, key), where one has each key once and a key may have a large part of many's rows.

    Rows of the heavy keys (those of many, a written table, unless given) are
    dealt into pieces by the column `by`; one's row goes to each of them.
    """
    heavy = heavy_keys(many, key) if heavy is None else heavy
    if not heavy:
        return many.join(one.hint("shuffle_hash"), key, how)
    spark = many.sparkSession
    listed = F.broadcast(spark.createDataFrame(heavy, f"{key} {many.schema[key].dataType.simpleString()}, __pieces int"))
    pieces = F.coalesce("__pieces", F.lit(1))
    left = many.join(listed, key, "left").withColumn("__piece", F.pmod(F.xxhash64(by), pieces).cast("int")).drop("__pieces")
    right = one.join(listed, key, "left").withColumn("__piece", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("__pieces")
    return left.join(right.hint("shuffle_hash"), [key, "__piece"], how).drop("__piece")


def crowded_join(left: DataFrame, right: DataFrame, key: list[str], left_by: str, right_by: str) -> DataFrame:
    """left.join(right, key) of written tables, where both sides may have many rows of a key.

    Keys with a large part of either side's rows are dealt into a grid: a left row
    goes to one line of it, a right row to one column, so that every pair of rows
    meets in one cell.  There are fewer than 2 * HEAVY such keys.
    """
    sides = []
    for rows, name in ((left, "__n"), (right, "__m")):
        total = rows.count()
        counts = rows.groupBy(*key).agg(F.count("*").alias(name))
        sides.append(counts.withColumn(f"{name}s", pieces_of(F.col(name), total)).where(f"{name}s > 1").drop(name))
    heavy = sides[0].join(sides[1], key, "full").select(*key, F.coalesce("__ns", F.lit(1)).alias("__lines"), F.coalesce("__ms", F.lit(1)).alias("__columns"))
    found = [tuple(r) for r in heavy.collect()]
    if not found:
        return left.join(right, key)
    listed = F.broadcast(left.sparkSession.createDataFrame(found, heavy.schema))
    place = lambda by, n: F.pmod(F.xxhash64(by), F.coalesce(n, F.lit(1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    a = left.join(listed, key, "left").withColumn("__line", place(left_by, F.col("__lines"))).withColumn("__column", every(F.col("__columns"))).drop("__lines", "__columns")
    b = right.join(listed, key, "left").withColumn("__column", place(right_by, F.col("__columns"))).withColumn("__line", every(F.col("__lines"))).drop("__lines", "__columns")
    return a.join(b, [*key, "__line", "__column"]).drop("__line", "__column")
