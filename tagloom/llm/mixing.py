"""Mixing sources to target weights.

Documents get hash-random keys.  Within each source, hash ranges (buckets) and
the order inside them give a distributed prefix sum of sizes, and the source is
cut at its exact budget; a budget above the source's size takes whole epochs
first.  Bucket counts follow the row count, so one source with a third of all
rows is spread like the others: no task gets more than a few buckets.  Rows
equal in key, source and size are summed to one before they meet, however many
they are.  Sources are numbered and their budgets found by distributed prefix
sums as well; only one number, the budget for a unit of weight, goes to the driver.

Null texts and texts without words have size 0 and nothing is taken of them;
very long texts are counted whole.  Null sources form one source, ordered last.
Rows without a doc_id, and rows that repeat one, count each; documents of one
random key are ordered by doc_id, then size.  Extra columns pass
through unless they have the name of a new one, which replaces it.  A source of
size 0 has target 0.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.order import numbered, running
from .common import WORD, bucket_bits, spread_join, staged


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


#: Bits of a document's key.
KEY_BITS = 60
#: Sources whose table is sent to all tasks, and copies of a row that one task writes.
FEW, COPIES = 100_000, 10_000


def order_key(salt: int, *keys: str) -> Column:
    """The first KEY_BITS bits of a digest of the salt and the keys (null ones left out)."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(salt), *[F.col(k).cast("string") for k in keys])), 1, KEY_BITS // 4), 16, 10).cast("bigint")


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, epochs: float) -> DataFrame:
    """sources (source, source_size) with place (by code points, null last), weight, target.

    Targets are shares of the budget by weight; none is above epochs times its
    size, the excess is dealt anew by weight.  So a target is the lesser of that
    limit and weight * unit, with one unit for all: in order of limit / weight the
    sources at their limit come first, and the unit is the largest that any
    number of them leaves to a source below its limit.
    """
    placed = numbered(sources, [F.col("source").asc_nulls_last()], "place", 0)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    placed = staged(placed.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(epochs))), "sources")
    some = placed.where("source_size > 0")
    size, total = some.agg(F.sum("source_size"), F.sum("weight")).first()
    if not size:
        return placed.withColumn("target", F.lit(0.0)).drop("limit")
    ahead = running(some.select("place", "weight", "limit", (F.col("limit") / F.col("weight")).alias("ratio")), F.struct("ratio", "place"), "weight", "limit")
    unit = (F.lit(share * size) - F.col("before_limit")) / (F.lit(total) - F.col("before_weight"))
    best = ahead.withColumn("unit", unit).where("unit * weight < limit").agg(F.max("unit")).first()[0]
    target = F.col("limit") if best is None else F.least(F.col("limit"), F.col("weight") * F.lit(best))
    return placed.withColumn("target", F.when(F.col("source_size") > 0, target).otherwise(F.lit(0.0))).drop("limit")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, epochs: int = 2, salt: int = 17, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs' key columns and source with size, source_size, target, epochs, taken.

    weights repeat over the sources in order of code points, null last.  taken
    counts words, repeats included; the document at the cut is taken in part.
    """
    base = staged(docs.select(*keys, "source", word_count(F.col("text")).alias("size")).groupBy(*keys, "source", "size").agg(F.count("*").alias("__many")), "sizes")
    sources = targets(base.groupBy("source").agg(F.sum(F.col("size") * F.col("__many")).alias("source_size")), weights, share, epochs)
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(epochs), F.floor(F.col("target") / F.col("source_size")))).otherwise(F.lit(0)).cast("int")
    rest = F.when(F.col("whole") < epochs, F.round("target").cast("bigint") - F.col("whole") * F.col("source_size")).otherwise(F.lit(0))
    named = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("null"))  # noqa: E731  a null source is one, too
    plan = staged(sources.withColumn("whole", whole).withColumn("rest", rest).select("source_size", "target", "whole", "rest", "place", named(F.col("source")).alias("__name")), "plan")
    keyed = base.withColumn("__key", order_key(salt, *keys)).withColumn("__name", named(F.col("source")))
    keyed = keyed.join(F.broadcast(plan), "__name") if plan.count() <= FEW else spread_join(staged(keyed, "keyed"), plan, "__name", "__key")
    rows, most = base.agg(F.count("*"), F.max("__many")).first()
    bits = bucket_bits(rows)
    keyed = keyed.drop("__name").withColumn("__bucket", F.shiftright("__key", KEY_BITS - bits)).withColumn("__mass", F.col("size") * F.col("__many"))
    per = keyed.groupBy("place", "__bucket").agg(F.sum("__mass").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("place").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    before = staged(per.select("place", "__bucket", F.coalesce(ahead, F.lit(0)).alias("ahead")), "prefix")
    inside = F.sum("__mass").over(Window.partitionBy("place", "__bucket").orderBy("__key", *keys, "size").rowsBetween(Window.unboundedPreceding, -1))
    start = F.col("ahead") + F.coalesce(inside, F.lit(0))
    out = keyed.join(before, ["place", "__bucket"]).withColumn("__start", start)
    # equal rows one after another: the cut can be in one of them
    if (most or 0) > COPIES:
        first = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__many") - 1) / COPIES) * COPIES, F.lit(COPIES).cast("bigint")))
        out = out.withColumn("__first", first).repartition("__key", "__first")
        out = out.withColumn("__nth", F.explode(F.sequence(F.col("__first"), F.least(F.col("__many"), F.col("__first") + COPIES) - 1)))
    else:
        out = out.withColumn("__nth", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__many") - 1)))
    part = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("size"), F.col("rest") - F.col("__start") - F.col("__nth") * F.col("size")))
    return out.select(*keys, "source", "size", "source_size", "target", F.col("whole").alias("epochs"), (F.col("whole") * F.col("size") + part).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, in docs' columns: a row for every time a document is taken.

    The document at a source's cut is taken when at least half of it is within
    the budget, so a source differs from its budget by half a document at most.
    Documents without words are never taken.  Rows that are equal in every
    column are told apart by number only: as many come out as were taken.
    """
    marked = docs.withColumn("__row", F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    copies = F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.greatest(F.col("size"), F.lit(1)))).cast("int")
    taken = mix(marked, keys=("doc_id", "__row"), **options).groupBy("doc_id", "__row").agg(F.sum(copies).cast("int").alias("__n"), F.count("*").alias("__m"))
    taken = staged(taken.select(F.col("doc_id").alias("__id"), F.col("__row").alias("__key"), "__n", "__m"), "taken")
    if taken.where("__m > 1").limit(1).count():
        marked = marked.dropDuplicates(["doc_id", "__row"])
    out = marked.join(taken.where("__n > 0"), (F.col("__row") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*[F.col(f"`{c}`") for c in docs.columns])
