"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph is a stretch of text up to a line end, or up to and with a sentence
end, without the blanks around it.  Every paragraph is hashed twice (128 bits),
and from those two hashes into every one of WIDE components; a document's vector
is the sum of its paragraphs' vectors, each component modulo 2**61.  So order
doesn't matter, documents can be joined by adding vectors, and a paragraph is
inserted or deleted by adding or subtracting its vector.  Equal wide parts mean
equal multisets of paragraphs, but for a collision of 128-bit hashes.

For likeness the vector goes on with LEVELS levels of WIDTH components, in which
a paragraph is added to one component only: the first level takes all
paragraphs, every further one those of 1/8 of the hash values of the level
before, for documents that touch all of its components.  The last component
counts the paragraphs.

The difference of two fingerprints tells how many paragraphs they don't share:
each unshared one changes one component of the first level, so the share of
equal components gives the number, and with the counts the Jaccard likeness of
the multisets.  The first level is read alone while it isn't full, and the sum
over all levels after that.  The number is off by about a quarter (standard
deviation) from some 30 up to more than 100 million unshared paragraphs, and
never less than the difference of the counts.

Null and empty texts, and texts of white space, have no paragraph: their vector
is zero, and two such are alike (1.0).  Repeated paragraphs count each, repeated rows
get a result each, an empty table gives an empty result, and only doc_id and text
are read, whatever else the table has.  Very long texts are hashed paragraph by
paragraph.  Everything here is native expressions.
"""

from __future__ import annotations

import math
from decimal import Decimal
from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import counted_heavy, spread_join, staged

WIDE = 8  # components that every paragraph changes
WIDTH, LEVELS, SAMPLED = 32, 8, 3  # components, levels, bits of the hash that thin out a level
LANES = WIDE + WIDTH * LEVELS + 1
MASK = (1 << 61) - 1
#: Ends of paragraphs.
ENDS = r"(?<=[.!?])\s+|[\r\n]+"


def paragraphs(text: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ENDS), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != F.lit(""))


def let(value: Column, use) -> Column:
    """use(value) with value computed once: it is bound as a lambda's variable."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def vector(parts: Column) -> Column:
    """array<bigint> of LANES components from an array of paragraphs."""
    return let(F.transform(parts, lambda p: F.struct(F.xxhash64(p).alias("a"), F.xxhash64(F.lit(1), p).alias("b"))), vector_of_hashes)


def vector_of_hashes(pairs: Column) -> Column:
    """The vector from two hashes (a, b) of each paragraph."""
    zero = F.lit(0).cast("bigint")
    total = lambda hs: F.aggregate(hs, zero, lambda a, h: (a + F.shiftrightunsigned(h, 3)).bitwiseAND(F.lit(MASK)))
    bits = lambda h, shift, many: F.shiftright(h, shift).bitwiseAND(F.lit(many - 1)) if shift else h.bitwiseAND(F.lit(many - 1))

    def lanes(hs: Column, shift: int, wide: int, deep: int) -> Column:
        """wide * deep components: the hashes are dealt into wide groups first, so that each is looked at wide + deep times."""
        group = lambda g: F.filter(hs, lambda h: bits(h, shift, wide) == g)
        rows = lambda own: F.transform(F.sequence(zero, F.lit(deep - 1).cast("bigint")), lambda k: total(F.filter(own, lambda h: bits(h, shift + 8, deep) == k)))
        return F.flatten(F.transform(F.sequence(zero, F.lit(wide - 1).cast("bigint")), lambda g: let(group(g), rows)))

    def levels(hs: Column, level: int) -> Column:
        """The components of this level and of all further ones, from the hashes that belong to it."""
        own = lanes(hs, 44 if level else 0, 8, WIDTH // 8)
        if level == LEVELS - 1:
            return own
        none = F.array_repeat(zero, WIDTH * (LEVELS - 1 - level))
        thinned = F.filter(hs, lambda h: bits(h, 20 + SAMPLED * level, 1 << SAMPLED) == zero)
        return F.concat(own, let(thinned, lambda s: F.when(F.size(s) == 0, none).otherwise(levels(s, level + 1))))

    value = lambda k, h: F.shiftrightunsigned(F.xxhash64(F.lit(k), h["a"], h["b"]), 3)
    summed = lambda k: F.aggregate(pairs, zero, lambda total, h: (total + value(k, h)).bitwiseAND(F.lit(MASK)))
    wide = [summed(k) for k in range(WIDE)]
    narrow = let(F.transform(pairs, lambda h: h["a"]), lambda hs: levels(hs, 0))
    return F.concat(F.array(*wide), narrow, F.array(F.size(pairs).cast("bigint")))


def add(a: Column, b: Column, sign: int = 1) -> Column:
    """The vector of both documents together (sign 1), or of the first without the second's paragraphs (-1)."""
    return F.zip_with(a, b, lambda x, y: (x + y if sign > 0 else x - y).bitwiseAND(F.lit(MASK)))


def text_form(v: Column) -> Column:
    """The fingerprint as a string: hexadecimal components, joined by full stops."""
    return F.array_join(F.transform(v, lambda x: F.lower(F.hex(x))), ".")


@cache
def unshared_by_equal() -> list[float]:
    """For 0, 1, ... WIDTH * LEVELS equal components of all levels: the number of unshared paragraphs that leaves as many on average."""

    def equal(n: float) -> float:
        return sum(WIDTH * math.exp(n / (1 << SAMPLED * k) * math.log(1 - 1 / WIDTH)) for k in range(LEVELS))

    def solved(total: float) -> float:
        low, high = 0.0, 64.0  # powers of two
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if equal(2**middle) > total else (low, middle)
        return 2**low

    return [solved(max(total, 0.5)) for total in range(WIDTH * LEVELS + 1)]


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness (0 to 1) of two documents' paragraphs from their vectors; 1 for equal vectors."""

    def equal(first: Column) -> Column:
        pairs = F.zip_with(F.slice(a, first, F.lit(WIDTH)), F.slice(b, first, F.lit(WIDTH)), lambda x, y: (x == y).cast("int"))
        return F.aggregate(pairs, F.lit(0), lambda n, x: n + x)

    def unshared(same: Column) -> Column:
        first, total = F.get(same, F.lit(0)), F.aggregate(same, F.lit(0), lambda n, x: n + x)
        return F.when(first > 2, F.log(first / F.lit(float(WIDTH))) / F.lit(math.log(1 - 1 / WIDTH))).otherwise(F.get(F.array(*map(F.lit, unshared_by_equal())), total))

    many = [F.element_at(v, LANES).cast("double") for v in (a, b)]
    both = many[0] + many[1]
    same = F.transform(F.array(*(F.lit(WIDE + 1 + WIDTH * k) for k in range(LEVELS))), equal)
    apart = F.greatest(F.abs(many[0] - many[1]), F.least(both, let(same, unshared)))
    return F.when(a == b, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (both - apart) / (both + apart))))


def followers(table: DataFrame) -> DataFrame:
    """table's rows (k, n; k unique) as a ring in descending order of k: k, next_k, prev_k, prev_n.

    Range partitions are sorted each on its own; only the first and last row
    of every partition go on to one task.
    """
    ranged = staged(table.repartitionByRange(F.col("k").desc()).withColumn("pid", F.spark_partition_id()), "ranged")
    w = Window.partitionBy("pid").orderBy(F.col("k").desc())
    row = F.struct("k", "n")
    inner = ranged.select("pid", "k", F.lead("k").over(w).alias("nx"), F.lag(row).over(w).alias("pv"))
    edge = ranged.groupBy("pid").agg(F.max("k").alias("head"), F.min(row).alias("tail"))
    ring = Window.orderBy("pid")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edge = edge.select(
        F.col("pid").alias("edge_pid"),
        F.coalesce(F.lead("head").over(ring), F.first("head").over(whole)).alias("nx_head"),
        F.coalesce(F.lag("tail").over(ring), F.last("tail").over(whole)).alias("pv_tail"),
    )
    out = inner.join(edge, F.col("pid") == F.col("edge_pid"))
    pv = F.coalesce("pv", "pv_tail")
    return out.select("k", F.coalesce("nx", "nx_head").alias("next_k"), pv["k"].alias("prev_k"), pv["n"].alias("prev_n"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint (string) and vector of every row of docs."""
    v = vector(paragraphs(F.col("text")))
    return docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars"), v.alias("vector")).withColumn("fingerprint", text_form(F.col("vector")))


#: Keys hold any bigint, and one below them all that stands for a null doc_id.
KEY = "decimal(20,0)"
NO_ID = Decimal(-(1 << 63) - 1)


def edited_against_next(docs: DataFrame) -> DataFrame:
    """Every document against an edit of itself and against its neighbour.

    The edit replaces the last half of the code points (rounded down) by the
    first as many of the next document in descending doc_id; the last document
    is followed by the first.  A null doc_id sorts last.  Rows that repeat a
    doc_id each get a result; as another row's neighbour, the text with the
    smallest SHA-256 digest stands for them.

    Texts are shuffled once, by doc_id; of each, the beginning that its
    predecessor needs and the vector are shuffled once more.  A text's vector is
    computed on both sides of that exchange: it is as large as most texts.
    """
    kind = docs.schema["doc_id"].dataType
    none = F.lit(NO_ID).cast(KEY)
    # both uses of base have the same columns, so that its exchange is made once
    base = docs.select(F.coalesce(F.col("doc_id").cast("bigint").cast(KEY), none).alias("k"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    sizes = staged(base.groupBy("k").agg(F.max(F.length("text")).alias("n"), F.count("*").alias("many")), "sizes")
    ring = staged(followers(sizes.select("k", "n")), "ring")
    # k is unique on the built sides, so a partition's table is as small as the partition; sorting the texts would cost more
    # a key of very many rows (those without a doc_id) is dealt over tasks by the rows' texts
    heavy = counted_heavy(sizes, "k", "many")
    heads = spread_join(base, ring.select("k", "prev_k", "prev_n"), "k", "text", heavy)
    if sizes.where("many > 1").limit(1).count():
        digest = F.sha2("text", 256)
        chosen = base.select("k", digest.alias("sha")).groupBy("k").agg(F.min("sha").alias("sha"))
        heads = spread_join(heads, chosen, "k", "text", heavy).where(digest == F.col("sha")).dropDuplicates(["k"])
    heads = heads.select(F.col("prev_k").alias("k"), F.expr("left(text, cast(floor(prev_n / 2) as int))").alias("head"), vector(paragraphs(F.col("text"))).alias("next_v"))
    rows = spread_join(base, heads, "k", "text", heavy).withColumn("n_chars", F.length("text"))
    half = "cast(floor(n_chars / 2) as int)"
    rows = rows.withColumn("edited", F.expr(f"concat(left(text, n_chars - {half}), left(head, {half}))"))
    rows = rows.select(
        F.when(F.col("k") != none, F.col("k")).cast(kind).alias("doc_id"),
        F.col("n_chars").cast("bigint"),
        F.sha2("edited", 256).alias("edited_sha256"),
        vector(paragraphs(F.col("text"))).alias("v"),
        vector(paragraphs(F.col("edited"))).alias("w"),
        "next_v",
    )
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        text_form(F.col("v")).alias("fingerprint"),
        text_form(F.col("w")).alias("edited_fingerprint"),
        likeness(F.col("v"), F.col("w")).alias("near_edited"),
        likeness(F.col("v"), F.col("next_v")).alias("near_next"),
    )
