"""Dictionary maps from variants to canonical names, and token lists mapped by them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions import tokens as T
from ..functions.text import label_name, strip


def lookup_table(mapping: DataFrame, line: str | None = None) -> DataFrame:
    """key, value of a dictionary (from, to): its keys as they are and in lower case; of repeated keys the last line counts."""
    order = F.col(line) if line else F.lit(0)
    rows = mapping.where("`from` is not null and trim(`from`) <> '' and `to` is not null").select(F.col("from").alias("key"), F.col("to").alias("value"), order.alias("line"))
    both = rows.withColumn("as_is", F.lit(1)).union(rows.withColumn("key", F.lower("key")).withColumn("as_is", F.lit(0)))
    return both.groupBy("key").agg(F.max_by("value", F.struct("line", "as_is", "value")).alias("value"))


def unigram_frequency(mapping: DataFrame) -> DataFrame:
    """word, n: words of the dictionary's names."""
    return mapping.select(F.explode(F.split(F.lower(strip(F.col("value"))), r"\s+")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def resolve_tokens(tokens: DataFrame, mapping: DataFrame, use_frequency: bool = False, collapse_repeats: bool = False, canonicalizer=None) -> DataFrame:
    """token, name for distinct tokens (column token): the token pipeline with both dictionary lookups as joins; dropped tokens have no row.

    The pipeline runs once for each distinct token, whatever their number in the lists.
    """
    raw = canonicalizer(F.col("token")) if canonicalizer else F.col("token")

    def found(df: DataFrame, column: str) -> DataFrame:
        side = mapping.select(F.col("key").alias("__k"), F.col("value").alias("__v"))
        low = mapping.select(F.col("key").alias("__k2"), F.col("value").alias("__v2"))
        out = df.join(side, F.col(column) == F.col("__k"), "left").join(low, F.lower(F.col(column)) == F.col("__k2"), "left")
        return out.withColumn(column, F.coalesce("__v", "__v2", column)).drop("__k", "__v", "__k2", "__v2")

    df = found(tokens.select("token").distinct().withColumn("__x", strip(raw)), "__x")
    if use_frequency:  # of several words those most frequent in the dictionary, looked up by a join
        rows = df.select("token", T.first_words(F.col("__x")).alias("__w"))
        words = rows.select("token", F.posexplode("__w").alias("__pos", "__word")).join(unigram_frequency(mapping), F.lower("__word") == F.col("word"), "left")
        lists = words.groupBy("token").agg(F.array_sort(F.collect_list(F.struct("__pos", "__word", F.coalesce("n", F.lit(0).cast("bigint")).alias("n")))).alias("__l"))
        best = F.filter("__l", lambda w: w["n"] == F.array_max(F.col("__l.n")))
        df = rows.select("token").join(lists, "token", "left").withColumn("__x", F.coalesce(T.short_phrase(best["__word"]), F.when(F.col("__l").isNull(), F.lit("")))).drop("__l")
    else:
        df = df.withColumn("__x", T.first_pass(F.col("__x")))
    df = found(df, "__x").withColumn("name", T.last_pass(F.col("__x"), collapse_repeats))
    return df.where("name is not null").select("token", "name")


def map_lists(df: DataFrame, column: str, names: DataFrame, row_key: list[str], max_tokens: int = 120, distinct: bool = True, out: str | None = None, keep_unmapped: bool = False) -> DataFrame:
    """df with a list column's first max_tokens tokens replaced by their names (token, name).

    Tokens without a name go (keep_unmapped: stay as they are); distinct keeps each
    name's first place only.  One join on tokens and one aggregation by row.
    """
    rows = df.select(*row_key, F.posexplode(F.slice(F.coalesce(F.col(column), F.array().cast("array<string>")), 1, max_tokens)).alias("__pos", "token"))
    joined = rows.join(names, "token", "left").withColumn("name", F.coalesce("name", "token") if keep_unmapped else F.col("name")).where("name is not null")
    lists = joined.groupBy(*row_key).agg(F.array_sort(F.collect_list(F.struct("__pos", "name"))).alias("__l")).select(*row_key, F.col("__l.name").alias("__n"))
    kept = F.coalesce("__n", F.array().cast("array<string>"))
    return df.join(lists, row_key, "left").withColumn(out or column, F.array_distinct(kept) if distinct else kept).drop("__n")


def summary(mapping: DataFrame, top: int = 50) -> tuple[DataFrame, DataFrame]:
    """Counts of a dictionary (entries, identities, merges, targets), and its targets with most variants."""
    same = F.col("from") == F.col("to")
    counts = mapping.agg(F.count("*").alias("entries"), F.count_if(same).alias("identities"), F.count_if(~same).alias("merges"), F.countDistinct("to").alias("targets"))
    targets = mapping.where(~same).groupBy("to").agg(F.count("*").alias("variants")).orderBy(F.desc("variants"), "to").limit(top)
    return counts, targets


def label_mapping(mapping: DataFrame, line: str | None = None) -> DataFrame:
    """from, to of a dictionary of labels: both sides clean; blank and generic labels, brackets and identities left out; of repeated ones the last line counts."""
    from .labels import usable

    rows = mapping.select(label_name(F.col("from")).alias("from"), label_name(F.col("to")).alias("to"), (F.col(line) if line else F.lit(0)).alias("line"))
    rows = usable(usable(rows, "from"), "to").where("`from` <> `to`")
    return rows.groupBy("from").agg(F.max_by("to", F.struct("line", "to")).alias("to"))


def canonical_names(tokens: DataFrame, names: DataFrame) -> DataFrame:
    """token, name for distinct tokens (column token): plurals as the dictionary's names (column name) have them; both sides meet in one join."""
    words = tokens.select("token").distinct()
    free, named, bare = T.singular_candidates(F.col("token"))
    known = names.select(F.col("name").alias("bare"), F.lit(True).alias("ok")).distinct()
    forms = words.select("token", free.alias("free"), named.alias("named"), bare.alias("bare")).join(known, "bare", "left")
    listed = F.col("bare").isin(*[f for fs in lexicon.CANONICAL_SETS.values() for f in fs]) | F.col("ok")
    return forms.select("token", F.when(F.col("free"), F.coalesce("named", F.when(listed, F.col("bare")), "token")).otherwise(F.col("token")).alias("name"))
