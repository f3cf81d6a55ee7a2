"""Similarity joins of vectors and phrases, and leader clustering.

Joins on what two names share (a segment, a component, a word) first look for
candidates that no pair at the threshold can do without, then compare these.  Keys
that very many names share are dealt over tasks.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import levenshtein_ratio, overlap_tokens, strip
from ..storage import map_batches, staged
from .order import numbered, top_per_group
from .spread import crowded_join, spread_join


def _blocks(df: DataFrame, key: str, vector: str, group: str | None, block: int) -> tuple[DataFrame, DataFrame]:
    """Rows dealt over pairs of blocks within their group, as left and right sides."""
    grp = F.col(group).cast("string") if group else F.lit("")
    rows = df.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.coalesce(grp, F.lit("")).alias("g"), F.col(vector).cast("array<double>").alias("v"))
    sizes = rows.groupBy("g").agg(F.ceil(F.count("*") / block).cast("int").alias("k"))
    rows = rows.join(sizes, "g").withColumn("own", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    left = rows.select("g", F.col("own").alias("i"), every.alias("j"), F.lit(0).alias("side"), "id", "v")
    right = rows.select("g", every.alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"), "id", "v")
    return left, right


def _met(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    left, right = (pdf[pdf["side"] == s].sort_values("id") for s in (0, 1))
    a, b = (np.array(x["v"].tolist(), float).reshape(len(x), -1) for x in (left, right))
    if not len(a) or not len(b):
        return left["id"].to_numpy(), right["id"].to_numpy(), np.zeros((len(a), len(b)))
    norm = lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) > 0, n, 1)
    return left["id"].to_numpy(), right["id"].to_numpy(), norm(a) @ norm(b).T


def cosine_pairs(df: DataFrame, key: str, vector: str, threshold: float, group: str | None = None, block: int = 2048) -> DataFrame:
    """id_a < id_b, cosine >= threshold, within equal groups.

    All pairs are looked at, but only those at the threshold leave: groups are cut
    into blocks, and every pair of blocks is one matrix product in one task.
    """
    left, right = _blocks(df, key, vector, group, block)

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, c = _met(pdf)
        hit = c >= threshold
        if len(pdf) and pdf["i"].iloc[0] == pdf["j"].iloc[0]:
            hit &= a[:, None] < b[None, :]
        i, j = np.nonzero(hit & (a[:, None] != b[None, :]))
        low = a[i] < b[j]
        return pd.DataFrame({"id_a": np.where(low, a[i], b[j]), "id_b": np.where(low, b[j], a[i]), "cosine": c[i, j]})

    kind = df.schema[key].dataType.simpleString()
    return left.union(right).where("i <= j").groupBy("g", "i", "j").applyInPandas(pairs, f"id_a {kind}, id_b {kind}, cosine double")


def nearest(df: DataFrame, key: str, vector: str, k: int, group: str | None = None, block: int = 2048) -> DataFrame:
    """id, neighbor, cosine, rank: each vector's k nearest others within its group; every pair of blocks gives k for each row at most."""
    left, right = _blocks(df, key, vector, group, block)

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, c = _met(pdf)
        c[a[:, None] == b[None, :]] = -np.inf
        take = np.argsort(-c, axis=1, kind="stable")[:, :k]
        i = np.repeat(np.arange(len(a)), take.shape[1])
        j = take.ravel()
        keep = np.isfinite(c[i, j])
        return pd.DataFrame({"id": a[i][keep], "neighbor": b[j][keep], "cosine": c[i, j][keep]})

    kind = df.schema[key].dataType.simpleString()
    found = left.union(right).groupBy("g", "i", "j").applyInPandas(best, f"id {kind}, neighbor {kind}, cosine double")
    return top_per_group(found, ["id"], [F.desc("cosine"), F.asc("neighbor")], k)


def hashed_ngrams(df: DataFrame, phrase: str, dims: int = 256, n: int = 3, out: str = "vector") -> DataFrame:
    """df with a unit vector of hashed character n-grams, the hash a polynomial of code points: an embedding that needs no model."""
    padded = F.concat(F.lit(" "), F.lower(F.col(phrase)), F.lit(" "))
    first = F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1)))
    code = lambda i: sum((F.ascii(padded.substr(i + k, F.lit(1))) * 31 ** (n - 1 - k) for k in range(n)), F.lit(0).cast("bigint"))
    place = F.transform(first, lambda i: F.pmod(code(i), F.lit(dims)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.size(F.filter("__p", lambda p: p == d)).cast("double"))
    raw = df.withColumn("__p", place).withColumn("__c", counts)
    size = F.sqrt(F.aggregate("__c", F.lit(0.0), lambda t, x: t + x * x))
    return raw.withColumn("__n", size).withColumn(out, F.transform("__c", lambda x: x / F.col("__n"))).drop("__p", "__c", "__n")


def sparse_candidates(rows: DataFrame, threshold: float) -> DataFrame:
    """id_a < id_b: all pairs of sparse unit vectors (id, feature, weight) that can reach a cosine, and some more.

    Features are ordered from rare to frequent.  At the first feature f that two
    vectors share, their product is at most the product of what is left of their
    lengths from f on.  So f is a feature of both vectors where that rest is at least
    the threshold (the prefix), and the rests' product is, too: only prefixes are
    joined, and frequent features are seldom in them.
    """
    least = threshold - 1e-9
    order = F.array_sort(F.collect_list(F.struct("df", "feature", "weight")))
    df = rows.groupBy("feature").agg(F.count("*").alias("df"))
    # a hot feature's rows are dealt over tasks by their vectors
    vectors = spread_join(rows, df, "feature", "id").groupBy("id").agg(order.alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda t, x: t + x["weight"] * x["weight"])
    rest = F.aggregate("v", F.struct(F.col("all").alias("left"), F.array().cast("array<struct<feature:string,rest:double>>").alias("out")), lambda t, x: F.struct((t["left"] - x["weight"] * x["weight"]).alias("left"), F.when(F.sqrt(F.greatest(t["left"], F.lit(0.0))) >= least, F.concat(t["out"], F.array(F.struct(x["feature"].cast("string").alias("feature"), F.sqrt(F.greatest(t["left"], F.lit(0.0))).alias("rest"))))).otherwise(t["out"]).alias("out")))
    prefix = vectors.withColumn("all", square).select("id", F.explode(rest["out"]).alias("p")).select("id", "p.feature", "p.rest")
    prefix = staged(prefix, "prefixes")
    a, b = (prefix.select(F.col("id").alias(f"id_{s}"), "feature", F.col("rest").alias(f"rest_{s}")) for s in "ab")
    met = crowded_join(a, b, ["feature"], "id_a", "id_b").where("id_a < id_b").where(F.col("rest_a") * F.col("rest_b") >= least)
    return met.select("id_a", "id_b").distinct()


def sparse_cosine_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """id_a < id_b, cosine >= threshold > 0, of sparse vectors (id, feature, weight); exact.  Features of weight 0 or null count as absent, vectors without features have no pairs."""
    rows = rows.where("weight <> 0 AND id IS NOT NULL AND feature IS NOT NULL").groupBy("id", "feature").agg(F.sum(F.col("weight").cast("double")).alias("weight"))
    rows = staged(rows, "sparse")
    size = rows.groupBy("id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("size"))
    unit = staged(rows.join(size, "id").select("id", F.col("feature").cast("string").alias("feature"), (F.col("weight") / F.col("size")).alias("weight")), "unit")
    pairs = staged(sparse_candidates(unit, threshold), "candidates")
    whole = unit.groupBy("id").agg(F.collect_list("feature").alias("f"), F.collect_list("weight").alias("w"))

    def dots(batches):
        for batch in batches:
            out = []
            for fa, wa, fb, wb in zip(*(batch.column(c).to_pylist() for c in ("f_a", "w_a", "f_b", "w_b")), strict=True):
                other = dict(zip(fb, wb, strict=True))
                out.append(float(sum(w * other.get(f, 0.0) for f, w in zip(fa, wa, strict=True))))
            yield pa.RecordBatch.from_arrays([batch.column("id_a"), batch.column("id_b"), pa.array(out, pa.float64())], names=["id_a", "id_b", "cosine"])

    kind = unit.schema["id"].dataType.simpleString()
    return map_batches(_both(pairs, whole, "id", ("f", "w")), dots, f"id_a {kind}, id_b {kind}, cosine double").where(F.col("cosine") >= threshold)


def _both(pairs: DataFrame, rows: DataFrame, name: str, columns: tuple[str, ...]) -> DataFrame:
    """pairs (<name>_a, <name>_b) with the columns of both sides' rows (one for each name); a name of very many pairs is dealt over tasks."""
    for side, other in ("ab", "ba"):
        one = rows.select(F.col(name).alias(f"{name}_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in columns])
        pairs = spread_join(staged(pairs, "pairs"), one, f"{name}_{side}", f"{name}_{other}")
    return pairs


def _dot() -> Column:
    return F.aggregate(F.zip_with("v_a", "v_b", lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)


def word_set(phrase: Column) -> Column:
    return F.array_distinct(F.split(F.lower(phrase), r"\s+"))


def token_pairs(phrases: DataFrame, phrase: str, vector: str, threshold: float, overlap: bool = True) -> DataFrame:
    """phrase_a < phrase_b of unit vectors whose cosine reaches the threshold, and, with overlap, that share a word; exact either way.

    Candidates share a component that both vectors need to reach the threshold
    (see sparse_candidates); where that must be, also a word.
    """
    rows = staged(phrases.select(F.col(phrase).alias("p"), F.col(vector).cast("array<double>").alias("v")), "embedded")
    parts = rows.select(F.col("p").alias("id"), F.posexplode("v").alias("feature", "weight")).where("weight <> 0")
    pairs = sparse_candidates(staged(parts.select("id", F.col("feature").cast("string").alias("feature"), "weight"), "components"), threshold)
    if overlap:
        pairs = pairs.where(F.arrays_overlap(word_set(F.col("id_a")), word_set(F.col("id_b"))))
    met = _both(pairs.select(F.col("id_a").alias("p_a"), F.col("id_b").alias("p_b")), rows, "p", ("v",)).withColumn("cosine", _dot()).where(F.col("cosine") >= threshold)
    return met.select(F.col("p_a").alias("phrase_a"), F.col("p_b").alias("phrase_b"), "cosine")


def leaders(nodes: DataFrame, edges: DataFrame, node: str, rank: str, a: str, b: str, rounds: int | None = None) -> DataFrame:
    """node, leader of first-fit leader clustering: in rank order a node joins the first leader it has an edge to, or becomes one.

    Resolved in rounds: a node all of whose lower neighbours are no leaders becomes
    one; a node with a leader among them becomes none.  Each round is a join and
    decides one node at least; ranks in no relation to the edges take few rounds, a
    chain of n nodes in order of their ranks takes n.  rounds: refuses more.
    """
    ranks = staged(nodes.select(F.col(node).alias("v"), F.col(rank).alias("r")), "ranks")
    both = edges.select(F.col(a).alias("v"), F.col(b).alias("u")).union(edges.select(F.col(b), F.col(a)))
    low = both.join(ranks, "v").join(ranks.select(F.col("v").alias("u"), F.col("r").alias("ru")), "u").where("ru < r").select("v", "u", "ru").distinct()
    low = staged(low, "lower")
    state = staged(ranks.join(low.select("v").distinct().withColumn("__l", F.lit(True)), "v", "left").select("v", F.when(F.col("__l").isNull(), 1).otherwise(0).alias("s")), "state")
    for turn in itertools.count():
        if not state.where("s = 0").limit(1).count():
            break
        if turn == rounds:
            raise RuntimeError(f"nodes are still open after {rounds} rounds")
        seen = low.join(state.select(F.col("v").alias("u"), F.col("s").alias("su")), "u").groupBy("v").agg(F.max(F.when(F.col("su") == 1, 1).otherwise(0)).alias("some"), F.min(F.when(F.col("su") == 2, 1).otherwise(0)).alias("none"))
        fresh = state.join(seen, "v", "left").select("v", F.when(F.col("s") != 0, F.col("s")).when(F.col("some") == 1, 2).when(F.col("none") == 1, 1).otherwise(0).alias("s"))
        state = staged(fresh, "state")
    first = low.join(state.where("s = 1").select(F.col("v").alias("u")), "u", "left_semi").groupBy("v").agg(F.min_by("u", "ru").alias("leader"))
    out = state.join(first, "v", "left").select(F.col("v").alias(node), F.when(F.col("s") == 1, F.col("v")).otherwise(F.col("leader")).alias("leader"))
    return out


def dedupe_phrases(vocab: DataFrame, threshold: float = 0.88, min_len: int = 1, generic: tuple[str, ...] = (), vectors: DataFrame | None = None, levenshtein: float | None = None, identities: bool = False, overlap: bool = True) -> DataFrame:
    """from, to: phrases of a vocabulary (token, count) merged into leaders that are similar and, with overlap, share a word.

    Phrases rank by count, then length, then name.  A generic leader hands its
    cluster to its best other member; a cluster without one isn't merged.
    vectors: (token, vector) of another embedding; hashed n-grams without it.
    levenshtein: phrases of this ratio are compared even if they share no word.
    identities: a row for every phrase, those that aren't merged as they are.
    """
    rows = vocab.groupBy(F.lower(F.trim("token")).alias("token")).agg(F.sum("count").alias("count")).where(F.length("token") >= min_len)
    ranked = staged(numbered(rows, [F.desc("count"), F.length("token"), F.asc("token")], "rank"), "phrases")
    embedded = staged(hashed_ngrams(ranked, "token") if vectors is None else ranked.join(vectors.select("token", "vector"), "token"), "embedded")
    pairs = token_pairs(embedded, "token", "vector", threshold, overlap)
    if levenshtein is not None:
        near = levenshtein_pairs(embedded, "token", levenshtein).select(F.col("name_a").alias("phrase_a"), F.col("name_b").alias("phrase_b"))
        near = _both(near, embedded.select(F.col("token").alias("phrase"), F.col("vector").alias("v")), "phrase", ("v",)).withColumn("cosine", _dot()).where(F.col("cosine") >= threshold)
        pairs = pairs.select("phrase_a", "phrase_b").union(near.select("phrase_a", "phrase_b")).distinct()
    pairs = staged(pairs, "pairs")
    found = leaders(ranked, pairs, "token", "rank", "phrase_a", "phrase_b").join(ranked, "token")
    plain = ~F.col("token").isin(*generic) if generic else F.lit(True)
    best = found.where(plain).groupBy("leader").agg(F.min_by("token", "rank").alias("name"))
    out = found.join(best, "leader", "left").select(F.col("token").alias("from"), F.coalesce("name", "token").alias("to"))
    return out if identities else out.where("`from` <> `to`")


#: Segments of this mean length or more make an index; shorter ones tell too little, and names are compared by length.
SEGMENT = 3


def segment_candidates(rows: DataFrame, least: float) -> DataFrame:
    """x, y of rows (x, s: the compared text, n: its length) that can reach the ratio, x the longer, by shared segments.

    Two texts of lengths n >= m and a distance of at most d = n - ceil(least n) share
    one of the d + 1 segments into which the shorter is cut, and the places where it
    can begin in the longer are few: with k segments before it, at most k edits come
    before it and d - k behind it.  Only lengths whose segments have SEGMENT
    characters are met here; see length_candidates for the others.
    """
    # the shorter texts' segments, for each length n of a longer one
    n_of = F.sequence(F.col("n"), F.floor(F.col("n") / F.lit(least) + F.lit(1e-9)).cast("int"))
    short = rows.select(F.col("x").alias("y"), F.col("s").alias("t"), F.col("n").alias("m"), F.explode(n_of).alias("n"))
    short = short.withColumn("d", F.col("n") - F.ceil(F.col("n") * F.lit(least) - F.lit(1e-9)).cast("int")).where((F.col("n") - F.col("m") <= F.col("d")) & (F.col("m") >= SEGMENT * (F.col("d") + 1)))
    short = short.select("y", "m", "n", "d", "t", F.explode(F.sequence(F.lit(0), F.col("d"))).alias("k"))
    start, size = _segment(F.col("m"), F.col("d"), F.col("k"))
    short = short.select("y", "m", "n", "k", F.substring(F.col("t"), start + 1, size).alias("segment"))
    # the longer texts' pieces that can be such segments
    long = rows.withColumn("d", F.col("n") - F.ceil(F.col("n") * F.lit(least) - F.lit(1e-9)).cast("int"))
    long = long.select("x", "s", "n", "d", F.explode(F.sequence(F.greatest(F.col("n") - F.col("d"), F.lit(1)), F.col("n"))).alias("m")).where(F.col("m") >= SEGMENT * (F.col("d") + 1))
    long = long.select("x", "s", "n", "m", "d", F.explode(F.sequence(F.lit(0), F.col("d"))).alias("k"))
    start, size = _segment(F.col("m"), F.col("d"), F.col("k"))
    more = F.col("n") - F.col("m")
    first = F.greatest(start - F.col("k"), start + more - (F.col("d") - F.col("k")), F.lit(0))
    last = F.least(start + F.col("k"), start + more + (F.col("d") - F.col("k")), F.col("n") - size)
    long = long.select("x", "s", "n", "m", "k", size.alias("size"), first.alias("a"), last.alias("b")).where("a <= b")
    long = long.select("x", "m", "n", "k", F.explode(F.transform(F.sequence("a", "b"), lambda p: F.substring(F.col("s"), p + 1, F.col("size")))).alias("segment")).distinct()
    met = crowded_join(staged(long, "pieces"), staged(short, "segments"), ["n", "m", "k", "segment"], "x", "y")
    return met.where((F.col("m") < F.col("n")) | (F.col("x") < F.col("y"))).select("x", "y").distinct()


def _segment(m: Column, d: Column, k: Column) -> tuple[Column, Column]:
    """Start and length of the k-th of d + 1 segments of m characters: the last ones are one character longer."""
    short = F.floor(m / (d + 1)).cast("int")
    long = m - short * (d + 1)
    extra = F.greatest(k - (d + 1 - long), F.lit(0))
    return k * short + extra, short + F.when(k >= d + 1 - long, 1).otherwise(0)


def length_candidates(rows: DataFrame, least: float, parts: int = 16) -> DataFrame:
    """x, y of lengths that can reach the ratio but whose segments would be shorter than SEGMENT; each length is dealt over `parts` keys."""
    d = F.col("n") - F.ceil(F.col("n") * F.lit(least) - F.lit(1e-9)).cast("int")
    longer = rows.withColumn("d", d).select("x", "n", "d", F.pmod(F.xxhash64("x"), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.greatest(F.col("n") - F.col("d"), F.lit(1)), F.col("n"))).alias("m"))
    longer = longer.where(F.col("m") < SEGMENT * (F.col("d") + 1))
    shorter = rows.select(F.col("x").alias("y"), F.col("n").alias("m"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    return longer.join(shorter, ["m", "part"]).where((F.col("m") < F.col("n")) | (F.col("x") < F.col("y"))).select("x", "y")


def levenshtein_pairs(names: DataFrame, name: str, least: float) -> DataFrame:
    """name_a < name_b, ratio >= least, of the distinct names.

    The ratio bounds the lengths of two names and their distance.  Candidates share
    a segment at a possible place; where the ratio allows so many edits that
    segments would be too short, they are all names of the lengths in question.
    """
    low = F.lower(strip(F.col(name)))
    rows = names.select(F.col(name).alias("x"), low.alias("s"), F.length(low).alias("n")).where("x is not null and n > 0").distinct()
    rows = staged(rows, "names")
    met = segment_candidates(rows, least).union(length_candidates(rows, least))
    met = met.withColumn("ratio", levenshtein_ratio(F.col("x"), F.col("y"))).where(F.col("ratio") >= F.lit(least) - 1e-9)
    return met.select(F.least("x", "y").alias("name_a"), F.greatest("x", "y").alias("name_b"), "ratio")


def mergeable_pairs(names: DataFrame, name: str, least: float = 0.7) -> DataFrame:
    """name_a < name_b of distinct names that share a word that counts, or reach the Levenshtein ratio; joined on words and on segments."""
    words = staged(names.select(F.col(name).alias("x")).distinct().select("x", F.explode(overlap_tokens(F.col("x"))).alias("w")), "words")
    a, b = (words.select(F.col("x").alias(f"name_{s}"), "w") for s in "ab")
    shared = crowded_join(a, b, ["w"], "name_a", "name_b").where("name_a < name_b").select("name_a", "name_b")
    return shared.union(levenshtein_pairs(names, name, least).select("name_a", "name_b")).distinct()
