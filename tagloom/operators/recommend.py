"""Cross-label recommendations: bridge items, novel items, fusions of label pairs, for all pairs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_junk
from .network import adjacency
from .order import top_per_group


def label_pairs(labels: DataFrame, label: str = "label") -> DataFrame:
    """label_a < label_b, all pairs of a bounded list of labels."""
    a, b = (labels.select(F.col(label).alias(f"label_{x}")).distinct() for x in "ab")
    return a.join(b, F.col("label_a") < F.col("label_b"))  # labels were cut to the most frequent before


def considered(strictness: float) -> int:
    """How many of a label's items count: fewer where strictness is higher."""
    return max(25, int(50 * (1 - strictness * 0.5)))


def top_central(profile: DataFrame, centrality: DataFrame, n: int) -> DataFrame:
    """label, item, centrality, rank: of each label's 2n most frequent items that are in the graph, the n most central."""
    frequent = top_per_group(profile, ["label"], [F.desc("freq"), F.asc("item")], 2 * n).drop("rank")
    return top_per_group(frequent.join(centrality.select("item", "centrality"), "item"), ["label"], [F.desc("centrality"), F.asc("item")], n)


def bridges(edges: DataFrame, profile: DataFrame, pairs: DataFrame, centrality: DataFrame | None = None, top_n: int = 50, best: int | None = 10) -> DataFrame:
    """label_a, label_b, name, score, connects_a, connects_b (and rank): items with edges to both labels' top items.

    score = edges to a's * edges to b's * (1 + centrality).  For every label, its
    neighbours are found once; pairs then join two labels' neighbours on the item.
    """
    top = top_per_group(profile, ["label"], [F.desc("freq"), F.asc("item")], top_n).where(~is_junk(F.col("item")))
    near = adjacency(edges).withColumnsRenamed({"node": "name", "other": "item"}).where(~is_junk(F.col("name"))).join(top.select("label", "item"), "item")
    near = near.groupBy("label", "name").agg(F.array_sort(F.collect_set("item")).alias("items"))
    a, b = (near.select(F.col("label").alias(f"label_{x}"), "name", F.col("items").alias(f"connects_{x}")) for x in "ab")
    both = pairs.join(a, "label_a").join(b, ["label_b", "name"])
    central = F.lit(0.0)
    if centrality is not None:
        both = both.join(centrality.select(F.col("item").alias("name"), "centrality"), "name", "left")
        central = F.coalesce("centrality", F.lit(0.0))
    score = F.size("connects_a") * F.size("connects_b") * (1 + central)
    out = both.select("label_a", "label_b", "name", score.cast("double").alias("score"), F.slice("connects_a", 1, 3).alias("connects_a"), F.slice("connects_b", 1, 3).alias("connects_b"))
    return top_per_group(out, ["label_a", "label_b"], [F.desc("score"), F.asc("name")], best) if best else out


def novel(edges: DataFrame, profile: DataFrame, pairs: DataFrame, centrality: DataFrame, top_n: int = 50, quantile: float = 0.5, best: int | None = 10, weight: str | None = None) -> DataFrame:
    """label_a, label_b, name, pairs_with, strength: items of a that b never has, with an edge to a central item of b.

    Central are those of b's top items at the quantile of their centralities or above.
    strength is 1, or the edge's weight column.
    """
    graph = edges.select(F.col("ingredient_a").alias("x"), F.col("ingredient_b").alias("y"), *([F.col(weight).cast("double").alias("w")] if weight else [F.lit(1.0).alias("w")]))
    graph = graph.union(graph.select("y", "x", "w")).where("x <> y").groupBy("x", "y").agg(F.max("w").alias("w"))
    inside = graph.select(F.col("x").alias("item")).distinct()
    top = top_per_group(profile, ["label"], [F.desc("freq"), F.asc("item")], top_n).select("label", "item").join(inside, "item", "left_semi")
    top = top.join(centrality.select("item", "centrality"), "item", "left").na.fill(0.0, ["centrality"])
    cut = top.groupBy("label").agg(F.percentile("centrality", F.lit(quantile)).alias("cut"))
    partners = top.join(cut, "label").where("centrality >= cut").select(F.col("label").alias("label_b"), F.col("item").alias("pairs_with"), "centrality")
    own = profile.select(F.col("label").alias("label_a"), F.col("item").alias("name")).distinct().where(~is_junk(F.col("name")))
    have = profile.select(F.col("label").alias("label_b"), F.col("item").alias("name")).distinct()
    linked = own.join(graph.withColumnsRenamed({"x": "name", "y": "pairs_with", "w": "strength"}), "name").join(partners, "pairs_with")
    out = linked.join(pairs, ["label_a", "label_b"]).join(have, ["label_b", "name"], "left_anti")
    out = out.select("label_a", "label_b", "name", "pairs_with", "strength", (F.col("centrality") * F.col("strength")).alias("score"))
    return top_per_group(out, ["label_a", "label_b"], [F.desc("score"), F.asc("name"), F.asc("pairs_with")], best) if best else out


def fusions(edges: DataFrame, profile: DataFrame, pairs: DataFrame, centrality: DataFrame, strictness: float = 0.5) -> DataFrame:
    """pair, bridges, novel_from_a, novel_from_b: a report for every pair."""
    n = considered(strictness)
    key = ["label_a", "label_b"]
    found = bridges(edges, profile, pairs, centrality, n).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("rank", "name", "score", "connects_a", "connects_b"))).alias("x"))
    found = found.select(*key, F.transform("x", lambda s: F.struct(s["name"].alias("name"), s["score"].alias("score"), s["connects_a"].alias("connects_a"), s["connects_b"].alias("connects_b"))).alias("bridges"))
    both = pairs.select(*key).union(pairs.select(F.col("label_b").alias("label_a"), F.col("label_a").alias("label_b")))
    new = novel(edges, profile, both, centrality, n).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("rank", "name", "pairs_with", "strength"))).alias("x"))
    new = new.select(*key, F.transform("x", lambda s: F.struct(s["name"].alias("name"), s["pairs_with"].alias("pairs_with"), s["strength"].cast("bigint").alias("strength"))).alias("items"))
    out = pairs.select(*key).join(found, key, "left").join(new.withColumnRenamed("items", "novel_from_a"), key, "left")
    out = out.join(new.select(F.col("label_b").alias("label_a"), F.col("label_a").alias("label_b"), F.col("items").alias("novel_from_b")), key, "left")
    none = lambda c: F.coalesce(c, F.from_json(F.lit("[]"), out.schema[c].dataType))
    return out.select(F.concat_ws(" + ", "label_a", "label_b").alias("pair"), *key, *[none(c).alias(c) for c in ("bridges", "novel_from_a", "novel_from_b")])


def pair_scenarios(pairs: DataFrame, kept: DataFrame, label: str = "label") -> DataFrame:
    """The pairs of labels both of which are kept and not blank."""
    names = kept.select(F.col(label)).where(F.trim(label) != "").distinct()
    for side in ("label_a", "label_b"):
        pairs = pairs.join(names.select(F.col(label).alias(side)), side, "left_semi")
    return pairs.select("label_a", "label_b")
