"""Unions, intersections and differences of sources and vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def numbered_union(*sources: DataFrame, name: str = "source") -> DataFrame:
    """The rows of all sources, with the number of the source from 1; columns are matched by name."""
    parts = [df.select(F.lit(i).alias(name), "*") for i, df in enumerate(sources, 1)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def only_in_first(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The distinct keys of a that b doesn't have."""
    return a.select(key).where(F.col(key).isNotNull()).distinct().join(b.select(key), key, "left_anti")


def in_both(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The distinct keys that a and b have."""
    return a.select(key).where(F.col(key).isNotNull()).distinct().join(b.select(key), key, "left_semi")


def either(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The distinct keys of a and b."""
    return a.select(key).union(b.select(key)).where(F.col(key).isNotNull()).distinct()
