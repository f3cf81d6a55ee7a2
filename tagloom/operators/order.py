"""Positions and ranks without a window over all rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import staged


def numbered(df: DataFrame, order: list[Column], name: str, start: int = 1) -> DataFrame:
    """df with a running number in the given order (which must be total for reruns to agree).

    Rows are range-partitioned and sorted; the number is the place in the
    partition plus the rows of the partitions before, of which only the counts meet.
    """
    inside = F.monotonically_increasing_id()
    ranged = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__mark", inside), "numbered")
    part = F.shiftright("__mark", 33)
    counts = ranged.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("__part", before.alias("__before"))
    out = ranged.withColumn("__part", part).join(F.broadcast(counts), "__part")  # a row for each partition
    place = F.col("__mark").bitwiseAND(F.lit((1 << 33) - 1))
    return out.withColumn(name, F.col("__before") + place + start).drop("__mark", "__part", "__before")


def permuted(place: Column, n: int, seed: int, rounds: int = 4) -> Column:
    """Where a keyed permutation of 0 .. n - 1 puts a place: by arithmetic on the place alone, without a sort or shuffle.

    A Feistel network on a grid of n or a few more cells: line and column change in
    turn by digests of the other, which can be undone, so no two cells meet.  A place
    that leaves the range walks on until it is back, in at most as many steps as the
    grid has cells too many.
    """
    lines = math.isqrt(max(n - 1, 0)) + 1
    columns = -(-n // lines) if n else 1
    digest = lambda k, x: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit(k), x.cast("string"))), 1, 8), 16, 10).cast("bigint")

    def moved(x: Column) -> Column:
        line, column = F.floor(x / columns).cast("bigint"), F.pmod(x, F.lit(columns))
        for k in range(0, rounds, 2):
            line = F.pmod(line + digest(k, column), F.lit(lines))
            column = F.pmod(column + digest(k + 1, line), F.lit(columns))
        return line * columns + column

    x = moved(place.cast("bigint"))
    over = lines * columns - n  # fewer than lines; so many steps could be needed, 64 never are: one step misses with a chance of 1 / columns
    return x if not over else F.aggregate(F.sequence(F.lit(1), F.lit(min(over, 64))), x, lambda at, _: F.when(at < n, at).otherwise(moved(at)))


def running(df: DataFrame, order: Column, *values: str) -> DataFrame:
    """df with the sums of values over all rows before (before_<value>), in the given total order; partitions' sums alone meet in one task."""
    ranged = staged(df.repartitionByRange(order).withColumn("__pid", F.spark_partition_id()), "ranged")
    inside = Window.partitionBy("__pid").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("__pid").agg(*[F.sum(v).alias(f"__{v}") for v in values])
    above = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("__pid", *[F.coalesce(F.sum(f"__{v}").over(above), F.lit(0)).alias(f"__{v}") for v in values])
    out = ranged.join(F.broadcast(parts), "__pid")  # a row for each partition
    return out.withColumns({f"before_{v}": F.col(f"__{v}") + F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values}).drop("__pid", *[f"__{v}" for v in values])


def top_per_group(df: DataFrame, by: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of every group with their rank from 1; Spark limits groups before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def sampled(df: DataFrame, key: str, head: int | None = None, n: int | None = None, share: float | None = None, start: int | None = None, stop: int | None = None, seed: int = 42) -> DataFrame:
    """One of: the first rows by key, n rows by hash, a share of the rows by hash (0 to 1), or the rows from start to before stop by key."""
    if sum(x is not None for x in (head, n, share)) + (start is not None or stop is not None) != 1:
        raise ValueError("exactly one way to sample is needed")
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))
    if head is not None:
        return df.orderBy(key).limit(head)
    if n is not None:
        return df.orderBy(digest, key).limit(n)
    if share is not None:
        return df.where(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") < int(min(1.0, max(0.0, share)) * (1 << 32)))
    place = numbered(df, [F.col(key)], "__place", 0)
    return place.where((F.col("__place") >= (start or 0)) & (F.lit(True) if stop is None else F.col("__place") < stop)).drop("__place")
