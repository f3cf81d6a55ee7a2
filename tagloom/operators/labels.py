"""Labels of records: support, filters, hierarchy, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions.text import label_name, strip
from .order import top_per_group


def support(df: DataFrame, label: str) -> DataFrame:
    """label, count, most frequent first."""
    return df.groupBy(label).agg(F.count("*").alias("count")).orderBy(F.desc("count"), label)


def with_support(df: DataFrame, label: str, least: int, allowed: DataFrame | None = None) -> DataFrame:
    """Rows whose label has at least `least` rows (and is in allowed's column of that name)."""
    kept = df.groupBy(label).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select(label)
    out = df.join(kept, label, "left_semi")
    return out if allowed is None else out.join(allowed.select(label), label, "left_semi")


def downsampled(df: DataFrame, label: str, most: int, order: list[Column]) -> DataFrame:
    """At most `most` rows of each label, the first by order (a hash for a random sample)."""
    return top_per_group(df, [label], order, most, "__rank").drop("__rank")


def lookup_key(s: Column) -> Column:
    return F.regexp_replace(F.lower(strip(s)), "-", " ")


def with_parent(df: DataFrame, label: str, parents: DataFrame, child: str = "child", parent: str = "parent", out: str = "parent", aliases: dict[str, str] | None = None) -> DataFrame:
    """df with the label's parent (itself without one), after the common names of parents.

    Keys are compared in lower case with blanks for hyphens; of repeated keys the largest parent counts.
    """
    table = lexicon.PARENT_ALIASES if aliases is None else aliases
    side = parents.groupBy(lookup_key(F.col(child)).alias("__c")).agg(F.max(parent).alias("__p"))
    named = df.join(side, lookup_key(F.col(label)) == F.col("__c"), "left").withColumn("__p", F.coalesce("__p", label))
    if table:
        pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
        named = named.withColumn("__p", F.coalesce(F.try_element_at(pairs, lookup_key(F.col("__p"))), F.col("__p")))
    return named.drop("__c").withColumn(out, F.col("__p")).drop("__p")


def parent_support(counts: DataFrame, label: str, count: str, parent: str, preview: int = 12) -> DataFrame:
    """parent, the sum of its labels' counts, and the first labels by name."""
    return counts.groupBy(parent).agg(F.sum(count).alias(count), F.slice(F.array_sort(F.collect_set(label)), 1, preview).alias("labels"))


def profiles(records: DataFrame, label: str, item: str) -> DataFrame:
    """label, item, freq: occurrences of items in records of a label."""
    return records.groupBy(label, item).agg(F.count("*").alias("freq"))


def top_items(profile: DataFrame, label: str, item: str, n: int, freq: str = "freq") -> DataFrame:
    return top_per_group(profile, [label], [F.desc(freq), F.asc(item)], n)


def usable(df: DataFrame, label: str) -> DataFrame:
    """Rows whose label is a name: not blank, not a generic word, without brackets."""
    low = F.lower(strip(F.coalesce(F.col(label), F.lit(""))))
    return df.where((low != "") & ~low.isin(*lexicon.GENERIC_LABELS) & ~low.rlike(r"[\[\]{}]"))


def merged_counts(counts: DataFrame, label: str, count: str) -> DataFrame:
    """label, count: counts of labels that are one after cleaning, summed."""
    return counts.groupBy(label_name(F.col(label)).alias(label)).agg(F.sum(count).alias(count))


def with_several(df: DataFrame, labels: str) -> DataFrame:
    """rows, several: rows, and those with more than one label."""
    return df.agg(F.count("*").alias("rows"), F.count_if(F.size(labels) > 1).alias("several"))
