"""Near-duplicate documents by b-bit MinHash.

A document is its set of distinct k-word shingles (A-Z lower-cased; a text of
fewer words is one shingle; without words it has none and links with nothing).
Documents with equal sets are one class from the start.  Of each class the
minima of many hash functions are taken: groups of `rows` of them make band
keys, which name candidate pairs; the lowest b bits of each are kept as a packed
signature.  Candidates whose signatures agree in too few bits, corrected for
chance agreement, are dropped, as are those whose bitmaps (a bit for each of
`bits_wide` parts of the hash space) show that too many shingles aren't shared,
which is a bound and loses nothing; the rest are compared on their full sets,
and linked with a Jaccard similarity of `threshold` or more.

Pairs inside a bucket aren't listed.  First every member meets two centres of
its bucket, the smallest and the largest id.  While buckets hold members of
several components in large numbers, each gets another centre, which meets the
members of other components.  When few pairs across components are left, all of
them are looked at, inside a join over blocks of members, so that a large bucket
is many tasks; nothing but pairs whose signatures agree leaves the join.  So
every pair that shares a band is linked, already connected, or known to differ.
Rows of a large bucket, pairs of one centre, and exact copies are dealt over
tasks in pieces wherever they are joined or grouped by that key.  A pair with a similarity of exactly 0.8 shares
none of the bands with a probability of (1 - 0.8**5)**28, 1.5 in 100,000.

Null texts are empty.  Rows without a doc_id have no links and no component.
Rows that repeat a doc_id are one node, linked as any of them is.  Very long
texts are compared whole.  Only doc_id and text are read, whatever else the table
has; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import heavy_keys, map_batches, pieces_of, slices, spread_join, staged
from .graph import components
from .textstats import Words, mixed


@dataclass(frozen=True)
class Setting:
    words: int = 5
    threshold: Fraction = Fraction(4, 5)
    bands: int = 28
    rows: int = 5
    bits: int = 4
    seed: int = 41
    #: Standard deviations below the threshold at which signatures still count as candidates.
    slack: float = 5.0
    #: Parts of the hash space in the bitmaps, a multiple of 64.
    bits_wide: int = 1024
    #: Members of a bucket in a block, and parts over which a centre's comparisons are dealt.
    block: int = 256
    parts: int = 256
    #: Pairs across components for each row of a bucket up to which all are looked at, and rounds of centres before that at most.
    few: int = 8
    turns: int = 8

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    @property
    def longs(self) -> int:
        return (self.hashes + 63) // 64

    def least_equal(self) -> int:
        """Equal b-bit minima from which a pair is a candidate: the threshold's expectation less the slack."""
        chance = 2.0**-self.bits
        p = float(self.threshold) + (1 - float(self.threshold)) * chance
        return int(np.floor(self.hashes * p - self.slack * np.sqrt(self.hashes * p * (1 - p))))


def minima(sets: list[np.ndarray], setting: Setting) -> np.ndarray:
    """A row of 32-bit minima for each set (all ones for an empty one)."""
    rng = np.random.default_rng(setting.seed)
    a = rng.integers(0, 1 << 63, setting.hashes, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, setting.hashes, dtype=np.uint64)[:, None]
    out = np.full((len(sets), setting.hashes), 0xFFFFFFFF, np.uint32)
    held = np.empty((setting.hashes, 512), np.uint64)
    for i, s in enumerate(sets):
        for at in range(0, len(s), 512):
            part = s[at : at + 512]
            x = np.multiply(part[None, :], a, out=held[:, : len(part)])
            np.add(x, b, out=x)
            np.minimum(out[i], (x.min(axis=1) >> np.uint64(32)).astype(np.uint32), out=out[i])
    return out


def band_keys(m: np.ndarray, setting: Setting) -> np.ndarray:
    """A row of 64-bit keys: each hashes a band's minima and its number."""
    cut = m.reshape(len(m), setting.bands, setting.rows).astype(np.uint64)
    key = np.arange(1, setting.bands + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for r in range(setting.rows):
        key = mixed(key ^ cut[:, :, r])
    return key.view(np.int64)


def signatures(m: np.ndarray, setting: Setting) -> np.ndarray:
    """The b lowest bits of each minimum as b planes of packed bits: a row of longs, plane after plane."""
    planes = []
    for bit in range(setting.bits):
        on = np.zeros((len(m), setting.longs * 64), np.uint8)
        on[:, : setting.hashes] = (m >> np.uint32(bit)) & np.uint32(1)
        planes.append(np.packbits(on, axis=1, bitorder="little").view(np.int64))
    return np.hstack(planes) if planes else np.zeros((len(m), 0), np.int64)


def bitmaps(sets: list[np.ndarray], setting: Setting) -> np.ndarray:
    """A row of longs for each set: a bit for every part of the hash space that has a shingle."""
    on = np.zeros((len(sets), setting.bits_wide), np.uint8)
    for i, s in enumerate(sets):
        on[i, (s % np.uint64(setting.bits_wide)).astype(np.int64)] = 1
    return np.packbits(on, axis=1, bitorder="little").view(np.int64)


def can_reach(a: Column, b: Column, na: Column, nb: Column, setting: Setting) -> Column:
    """Whether sets of sizes na and nb with these bitmaps can have the threshold's similarity: a bit that one lacks is a shingle it lacks."""
    t = setting.threshold
    x = y = None
    for i in range(setting.bits_wide // 64):
        p, q = F.get(a, F.lit(i)), F.get(b, F.lit(i))
        only_p, only_q = F.bit_count(p.bitwiseAND(F.bitwise_not(q))), F.bit_count(q.bitwiseAND(F.bitwise_not(p)))
        x, y = (only_p, only_q) if x is None else (x + only_p, y + only_q)
    return ((na - x) * t.denominator >= (na + y) * t.numerator) & ((nb - y) * t.denominator >= (nb + x) * t.numerator)


def equal_minima(a: Column, b: Column, setting: Setting) -> Column:
    """How many b-bit minima two signatures share, by bit counts."""
    apart = None
    for word in range(setting.longs):
        differs = None
        for bit in range(setting.bits):
            x = F.get(a, F.lit(bit * setting.longs + word)).bitwiseXOR(F.get(b, F.lit(bit * setting.longs + word)))
            differs = x if differs is None else differs.bitwiseOR(x)
        apart = F.bit_count(differs) if apart is None else apart + F.bit_count(differs)
    return F.lit(setting.hashes) - apart


def similarity(a: Column, b: Column, setting: Setting) -> Column:
    """Estimated Jaccard similarity, corrected for minima that agree by chance."""
    chance = 2.0**-setting.bits
    return F.greatest(F.lit(0.0), (equal_minima(a, b, setting) / F.lit(float(setting.hashes)) - F.lit(chance)) / F.lit(1 - chance))


def sketches(docs: DataFrame, setting: Setting) -> DataFrame:
    """doc_id, n (set size), f1, f2 (fingerprint of the set), bands, signature, bitmap of every row."""

    def sketch(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = Words(part.column("text")).shingles(setting.words)
                m = minima(sets, setting)
                prints = [np.array([mixed(s ^ np.uint64(salt)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64) for salt in (1, 2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, prints), pa.array(list(band_keys(m, setting)), pa.list_(pa.int64())), pa.array(list(signatures(m, setting)), pa.list_(pa.int64())), pa.array(list(bitmaps(sets, setting)), pa.list_(pa.int64()))],
                    names=["doc_id", "n", "f1", "f2", "bands", "signature", "bitmap"],
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return map_batches(rows, sketch, "doc_id bigint, n bigint, f1 bigint, f2 bigint, bands array<bigint>, signature array<bigint>, bitmap array<bigint>")


def _near_sizes(a: Column, b: Column, setting: Setting) -> Column:
    t = setting.threshold
    return (a * t.denominator >= b * t.numerator) & (b * t.denominator >= a * t.numerator)


def confirm(docs: DataFrame, pairs: DataFrame, setting: Setting) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold.

    All pairs of an id a, the centre where there is one, meet in `parts` places
    at most; there its set is made once and those of its partners stream past.
    """
    t = setting.threshold

    def compare(batches):
        held, sets = None, []
        for batch in batches:
            for part in slices(batch, "text"):
                found: list[tuple[int, int]] = []
                made = Words(part.column("text")).shingles(setting.words)
                columns = (part.column(c).to_pylist() for c in ("a", "part", "b"))
                for a, place, b, s in zip(*columns, made, strict=True):
                    if held != (a, place):
                        held, sets = (a, place), []
                    if b is None:
                        sets.append(s)
                        continue
                    for other in sets:
                        if min(len(s), len(other)) * t.denominator < max(len(s), len(other)) * t.numerator or not len(s):
                            continue
                        common = len(s) + len(other) - len(np.union1d(s, other))
                        if common * t.denominator >= (len(s) + len(other) - common) * t.numerator:
                            found.append((a, b))
                            break
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])

    base = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text")
    pairs = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(setting.parts)))
    # a merge join whatever the sizes: texts are shuffled once, for both joins
    partners = base.join(pairs.hint("merge"), F.col("id") == F.col("b")).select("a", "part", "b", "text")
    centres = base.join(pairs.select("a", "part").distinct().hint("merge"), F.col("id") == F.col("a")).select("a", "part", F.lit(None).cast("bigint").alias("b"), "text")
    rows = centres.union(partners).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return map_batches(rows, compare, "a bigint, b bigint").distinct()


def links(docs: DataFrame, classes: DataFrame, setting: Setting) -> DataFrame:
    """id, component: the components of all links between classes (rid, n, bands, signature, bitmap)."""
    near = _near_sizes(F.col("na"), F.col("nb"), setting) & (equal_minima(F.col("sa"), F.col("sb"), setting) >= setting.least_equal()) & can_reach(F.col("ma"), F.col("mb"), F.col("na"), F.col("nb"), setting)
    keyed = classes.select("rid", F.explode("bands").alias("band"))
    buckets = staged(keyed.groupBy("band").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi"), F.count("*").alias("n")).where("lo < hi"), "buckets", classes.count() * setting.bands)
    rows = buckets.agg(F.sum("n")).first()[0] or 0
    buckets = buckets.withColumn("pieces", pieces_of(F.col("n"), rows)).drop("n")
    large = F.broadcast(buckets.where("pieces > 1").select("band", "pieces"))  # fewer than HEAVY
    piece = F.pmod(F.xxhash64("rid", "band"), F.coalesce("pieces", F.lit(1))).cast("int")
    dealt = keyed.join(large, "band", "left").select("rid", "band", piece.alias("piece"))
    # a bucket is known by its band; band and piece deal its rows
    everywhere = lambda table: table.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    members = staged(dealt.join(everywhere(buckets).hint("shuffle_hash"), ["band", "piece"]), "members")
    # only these texts are compared: they are shuffled and written once, whatever the number of rounds
    meant = members.select(F.col("rid").alias("doc_id")).distinct()
    docs = staged(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(meant.hint("shuffle_hash"), "doc_id", "left_semi"), "texts")
    signs = lambda side, i: classes.select(F.col("rid").alias(i), F.col("n").alias(f"n{side}"), F.col("signature").alias(f"s{side}"), F.col("bitmap").alias(f"m{side}"))

    def tried(pairs: DataFrame) -> DataFrame:
        """Candidates (a, b) by size and signature of pairs (x, y, hub); a is the hub, the side that meets its partners."""
        met = spread_join(pairs, signs("a", "x"), "x", "y")
        met = spread_join(met, signs("b", "y"), "y", "x", heavy_keys(pairs, "y")).where(near)
        other = F.when(F.col("hub") == F.col("x"), F.col("y")).otherwise(F.col("x"))
        return staged(met.select(F.col("hub").alias("a"), other.alias("b")), "candidates")

    ordered = lambda a, b: (F.least(a, b).alias("x"), F.greatest(a, b).alias("y"), F.col(a).alias("hub"))
    once = lambda pairs: pairs.groupBy("x", "y").agg(F.max("hub").alias("hub"))
    centres = F.explode(F.array(F.col("lo"), F.col("hi")))
    seen = staged(once(members.select("rid", centres.alias("a")).where("rid <> a").select(*ordered("a", "rid"))), "met", 2 * rows)
    candidates = tried(seen)
    linked = staged(confirm(docs, candidates, setting), "linked", candidates.count())
    before = float("inf")
    for turn in range(setting.turns + 1):
        labels = components(linked)
        own = members.join(labels.hint("shuffle_hash"), F.col("rid") == F.col("id"), "left").select("band", "piece", "pieces", "rid", F.coalesce("component", "rid").alias("label"))
        own = staged(own, "own")
        held = own.groupBy("band", "pieces", "label").agg(F.count("*").alias("k")).groupBy("band", "pieces").agg(F.sum("k").alias("many"), F.sum(F.col("k") * F.col("k")).alias("same"))
        split = staged(held.where("many * many > same and many > 2"), "split", members.count())
        cross, rows = split.agg(F.sum((F.col("many") * F.col("many") - F.col("same")) / 2), F.sum("many")).first()
        if not cross:
            return labels
        rest = own.drop("pieces").join(everywhere(split.select("band", "pieces", "many")).hint("shuffle_hash"), ["band", "piece"])
        # more centres help while they join components; else all pairs have to be looked at
        last = cross <= setting.few * rows or turn == setting.turns or cross > 0.8 * before
        before = float(cross)
        if last:
            pairs = _across(rest, classes, near, setting)
        else:  # another centre for each bucket: it meets the members of other components
            order = F.xxhash64("rid", "band", F.lit(turn))
            by_piece = rest.groupBy("band", "piece", "pieces").agg(F.min(F.struct(order.alias("o"), "rid", "label")).alias("c"))
            chosen = staged(by_piece.groupBy("band", "pieces").agg(F.min("c").alias("c")).select("band", "pieces", F.col("c.rid").alias("a"), F.col("c.label").alias("l")), "centres")
            pairs = once(rest.drop("pieces").join(everywhere(chosen).hint("shuffle_hash"), ["band", "piece"]).where("label <> l").select(*ordered("a", "rid")))
        fresh = staged(pairs.join(seen.select("x", "y"), ["x", "y"], "left_anti"), "met")
        candidates = fresh.select(F.col("x").alias("a"), F.col("y").alias("b")) if last else tried(fresh)
        if last and not candidates.limit(1).count():
            return labels
        linked = staged(linked.union(confirm(docs, candidates, setting)), "linked", linked.count() + candidates.count())
        if last:
            return components(linked)
        seen = staged(seen.union(fresh), "met", seen.count() + fresh.count())
    raise AssertionError("the last turn returns")


def _across(rest: DataFrame, classes: DataFrame, near: Column, setting: Setting) -> DataFrame:
    """All pairs (x < y) of a bucket (band, rid, label, many) with different labels whose signatures agree.

    Members are dealt into blocks; each pair of blocks is a key of the join, so a
    large bucket is many tasks, and the condition is part of the join.
    """
    blocks = F.floor((F.col("many") + (setting.block - 1)) / setting.block).cast("int")
    rows = rest.join(classes.select("rid", "n", "signature", "bitmap").hint("shuffle_hash"), "rid").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rid", F.lit(setting.seed)), F.col("blocks")).cast("int"))
    rows = staged(rows.select("band", "rid", "label", "n", "signature", "bitmap", "blocks", "block"), "rest")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = rows.select("band", F.col("block").alias("i"), every.alias("j"), F.col("rid").alias("x"), F.col("label").alias("lx"), F.col("n").alias("na"), F.col("signature").alias("sa"), F.col("bitmap").alias("ma")).where("i <= j")
    right = rows.select("band", every.alias("i"), F.col("block").alias("j"), F.col("rid").alias("y"), F.col("label").alias("ly"), F.col("n").alias("nb"), F.col("signature").alias("sb"), F.col("bitmap").alias("mb")).where("i <= j")
    on = [left["band"] == right["band"], left["i"] == right["i"], left["j"] == right["j"], F.col("lx") != F.col("ly"), (left["i"] < right["j"]) | (F.col("x") < F.col("y")), near]
    return left.join(right, on).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct().withColumn("hub", F.col("x"))


def dedup(docs: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included), kept, for every row of docs."""
    sketched = staged(sketches(docs, setting), "sketches")
    sets = sketched.where("n > 0 and doc_id is not null")
    sketch = F.struct("bands", "signature", "bitmap")
    classes = sets.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rid"), F.min_by(sketch, "doc_id").alias("s"), F.count("*").alias("copies"))
    classes = staged(classes.select("rid", "n", "f1", "f2", "copies", "s.bands", "s.signature", "s.bitmap"), "classes")
    chosen = classes.select("rid", "n", "bands", "signature", "bitmap")
    labels = links(docs, chosen, setting)
    # the rows of a class find its component by its fingerprint, those of a large one in pieces
    pieces = pieces_of(F.col("copies"), sketched.count())
    large = F.broadcast(classes.withColumn("pieces", pieces).where("pieces > 1").select("f1", "f2", "pieces"))  # fewer than HEAVY
    named = classes.select("rid", "f1", "f2", pieces.alias("pieces")).join(labels.hint("shuffle_hash"), F.col("rid") == F.col("id"), "left")
    named = named.select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("part"), F.coalesce("component", "rid").alias("component"))
    rows = sketched.select("doc_id", "n", "f1", "f2").join(large, ["f1", "f2"], "left").withColumn("piece", F.pmod(F.xxhash64("doc_id"), F.coalesce("pieces", F.lit(1))).cast("int"))
    able = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    out = rows.join(staged(named, "named"), able & (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & (F.col("piece") == F.col("part")), "left")
    component = F.coalesce(F.least("component", "doc_id"), "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id").isNull() | (component == F.col("doc_id"))).alias("kept"))


def kept_documents(docs: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """The rows of docs that stay: one document of each component; of rows equal in doc_id and text, one."""
    found = staged(dedup(docs, setting).select("doc_id", "kept"), "kept")
    repeated = bool(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count())
    ids = found.where("kept and doc_id is not null").select("doc_id").distinct()
    out = docs.join(ids.withColumnRenamed("doc_id", "__id"), F.col("doc_id") == F.col("__id"), "left_semi")
    if repeated:
        out = out.dropDuplicates(["doc_id", "text"])
    return out.union(docs.where("doc_id is null"))
