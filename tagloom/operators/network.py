"""Degrees and betweenness of co-occurrence graphs; label networks by shared terms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import staged
from .order import numbered, top_per_group
from .spread import HEAVY, LIGHT, crowded_join, spread_join


def adjacency(edges: DataFrame, a: str = "ingredient_a", b: str = "ingredient_b") -> DataFrame:
    """node, other: both directions of every edge, once."""
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).union(edges.select(F.col(b), F.col(a)))
    return both.where("node <> other").distinct()


def degrees(edges: DataFrame, a: str = "ingredient_a", b: str = "ingredient_b") -> DataFrame:
    """ingredient, degree, degree_centrality = degree / (nodes - 1)."""
    d = adjacency(edges, a, b).groupBy(F.col("node").alias("ingredient")).agg(F.count("*").alias("degree"))
    n = d.agg(F.count("*").alias("n"))
    return d.crossJoin(F.broadcast(n)).select("ingredient", "degree", (F.col("degree") / F.greatest(F.col("n") - 1, F.lit(1))).alias("degree_centrality"))  # one row on the right


def betweenness(edges: DataFrame, a: str = "ingredient_a", b: str = "ingredient_b", samples: int | None = None, seed: int = 42, most_edges: int | None = None, most_rows: int = 100_000_000) -> DataFrame:
    """node, betweenness: normalised, unweighted; from all sources, or from `samples` of them by hash, scaled up.

    Breadth-first searches from many sources at once, a join for each level: a row
    is a source and a node that it reaches on its level, with the number of shortest
    paths.  Back from the deepest level, a join for each level again, every node hands
    its dependency to its neighbours one level up.  Sources go in blocks, so that a
    block has most_rows rows of (source, node) at most; nothing of the graph comes to
    the driver.  most_edges: graphs with more edges are refused, if given.
    """
    graph = staged(adjacency(edges, a, b), "graph")
    if most_edges is not None and graph.count() > 2 * most_edges:
        raise ValueError(f"the graph has more than {most_edges} edges")
    names = staged(numbered(graph.groupBy("node").agg(F.count("*").alias("degree")), [F.col("node")], "v", 0), "nodes")
    n, ends, largest = names.agg(F.count("*"), F.coalesce(F.sum("degree"), F.lit(0)), F.coalesce(F.max("degree"), F.lit(0))).first()
    most = max(LIGHT, ends // HEAVY)
    heavy = [(r[0], -(-r[1] // most)) for r in names.where(F.col("degree") > most).select("node", "degree").collect()] if largest > most else []  # fewer than HEAVY
    ids = spread_join(graph, names.select("node", "v", "degree"), "node", "other", heavy).select("v", "degree", "other")
    ids = spread_join(ids, names.select(F.col("node").alias("other"), F.col("v").alias("w")), "other", "v", heavy).select("v", "degree", "w")
    degree = names.select("v", "degree")
    # long lists of neighbours go in pieces
    piece = F.pmod(F.xxhash64("w"), F.ceil(F.col("degree") / LIST))
    near = staged(ids.groupBy("v", piece.alias("piece")).agg(F.collect_list("w").alias("near")).select("v", "near"), "neighbours")
    chosen = names if samples is None or n <= samples else names.orderBy(F.md5(F.concat_ws(":", "node", F.lit(seed))), "node").limit(samples)
    m = min(n, samples) if samples is not None else n
    block = max(1, min(m, most_rows // max(n, 1)))
    sources = chosen.select(F.col("v").alias("s"))
    if block >= m:
        parts = [_dependencies(sources, near, degree, largest, block)] if m else []
    else:
        placed = staged(numbered(sources, [F.col("s")], "place", 0), "sources")
        parts = [_dependencies(placed.where((F.col("place") >= k) & (F.col("place") < k + block)).select("s"), near, degree, largest, block) for k in range(0, m, block)]
    scale = n / max(m, 1) / max((n - 1) * (n - 2), 1)
    if not parts:
        return names.select("node", F.lit(0.0).alias("betweenness"))
    total = reduce(DataFrame.unionByName, parts).groupBy("v").agg(F.sum("part").alias("part"))
    return names.join(total, "v", "left").select("node", (F.coalesce("part", F.lit(0.0)) * F.lit(scale)).alias("betweenness"))


#: Neighbours in one row; what a node may hand on within one task.
LIST, WORK = 100_000, 2_000_000


def _handed(rows: DataFrame, value: str, near: DataFrame, degree: DataFrame, largest: int, block: int) -> DataFrame:
    """s, v, and the sum of a value that every row's node hands to each of its neighbours; a node with much to hand is dealt over tasks by its sources."""
    heavy: list[tuple] = []
    if largest * block > WORK:
        work = rows.groupBy("v").agg(F.count("*").alias("n")).join(degree, "v").withColumn("pieces", F.ceil(F.col("n") * F.col("degree") / WORK).cast("int"))
        heavy = [(r[0], r[1]) for r in work.where("pieces > 1").select("v", "pieces").collect()]  # no more than all work / WORK
    met = spread_join(rows, near, "v", "s", heavy)
    return met.select("s", F.explode("near").alias("v"), value).groupBy("s", "v").agg(F.sum(value).alias(value))


def _dependencies(sources: DataFrame, near: DataFrame, degree: DataFrame, largest: int, block: int) -> DataFrame:
    """v, part: the dependencies of these sources on every node."""
    levels = [staged(sources.select("s", F.col("s").alias("v"), F.lit(1.0).alias("paths")), "level")]
    while True:
        # a neighbour of a level is on it, on the one before, or on the next
        known = reduce(DataFrame.unionByName, [x.select("s", "v") for x in levels[-2:]])
        found = staged(_handed(levels[-1], "paths", near, degree, largest, block).join(known, ["s", "v"], "left_anti"), "level")
        if found.isEmpty():
            break
        levels.append(found)
    share, shares = levels[-1].withColumn("part", F.lit(0.0)), []
    for level in reversed(levels[1:-1]):
        given = _handed(share.withColumn("given", (1 + F.col("part")) / F.col("paths")).select("s", "v", "given"), "given", near, degree, largest, block)
        share = staged(level.join(given, ["s", "v"], "left").withColumn("part", F.col("paths") * F.coalesce("given", F.lit(0.0))).drop("given"), "share")
        shares.append(share.select("v", "part"))
    if not shares:
        return levels[0].select("v", F.lit(0.0).alias("part"))
    return staged(reduce(DataFrame.unionByName, shares).groupBy("v").agg(F.sum("part").alias("part")), "dependencies")


def shared_terms(profiles: DataFrame, label: str, term: str, weight: str, min_shared: int = 2, preview: int = 10, top: int | None = None) -> DataFrame:
    """label_a < label_b with the number of terms they share, the sum of both weights over them, and the heaviest of them.

    top: only each label's heaviest terms.  Joined on the term; a term of very
    many labels is dealt over tasks, but all pairs of its labels are a result, so
    take top first where labels are many.
    """
    rows = profiles.groupBy(F.col(label).alias("l"), F.col(term).alias("t")).agg(F.sum(weight).alias("w"))
    if top:
        rows = top_per_group(rows, ["l"], [F.desc("w"), F.asc("t")], top).drop("rank")
    rows = staged(rows.select("l", "t", "w"), "terms")
    a, b = (rows.select(F.col("l").alias(f"label_{x}"), F.col("t"), F.col("w").alias(f"w_{x}")) for x in "ab")
    both = crowded_join(a, b, ["t"], "label_a", "label_b").where("label_a < label_b")
    total = F.col("w_a") + F.col("w_b")
    heavy = F.slice(F.array_sort(F.collect_list(F.struct((-total).alias("w"), "t"))), 1, preview)
    return both.groupBy("label_a", "label_b").agg(F.count("*").alias("shared"), F.sum(total).alias("score"), heavy["t"].alias("terms")).where(F.col("shared") >= min_shared)


def rolled_up(profiles: DataFrame, label: str, term: str, weight: str, parents: DataFrame, child: str, parent: str) -> DataFrame:
    """parent, term, weight: profiles summed by the parents of their labels; labels without parent stand for themselves."""
    side = parents.select(F.col(child).alias("__c"), F.col(parent).alias("__p"))
    named = profiles.join(side, F.col(label) == F.col("__c"), "left").withColumn("parent", F.coalesce("__p", label))
    return named.groupBy("parent", term).agg(F.sum(weight).alias(weight))


def hierarchy_edges(labels: DataFrame, label: str, parents: DataFrame, child: str, parent: str) -> DataFrame:
    """parent, child: an edge for every label of the network whose parent is another label."""
    side = parents.select(F.col(child).alias("__c"), F.col(parent).alias("parent"))
    return labels.select(F.col(label).alias("child")).distinct().join(side, F.col("child") == F.col("__c")).where("parent <> child").select("parent", "child").distinct()


def merged_metrics(nodes: DataFrame, name: Column, *metrics: str) -> DataFrame:
    """node and the largest of each metric over the nodes that have one name; nodes without a name go."""
    return nodes.groupBy(name.alias("node")).agg(*[F.max(m).alias(m) for m in metrics]).where("node is not null")


def label_nodes(support: DataFrame, label: str, count: str, terms: DataFrame, parents: DataFrame, child: str, parent: str, most_terms: int = 8, most_children: int = 12) -> DataFrame:
    """node, kind, parent, support, size, preview of a label network: its labels (label, count) and the parents these have.

    size is ln(1 + support); a label's preview are its heaviest terms (label, term,
    weight), a parent's the first of its labels by name.
    """
    heavy = top_per_group(terms.select(F.col(label), "term", "weight"), [label], [F.desc("weight"), F.asc("term")], most_terms)
    heavy = heavy.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("t")).select(label, F.array_join("t.term", ", ").alias("preview"))
    tree = parents.select(F.col(child).alias(label), F.col(parent).alias("parent"))
    rows = support.select(label, F.col(count).cast("bigint").alias("support")).join(tree, label, "left").join(heavy, label, "left")
    own = rows.select(F.col(label).alias("node"), F.lit("label").alias("kind"), F.coalesce("parent", F.lit("")).alias("parent"), "support", F.coalesce("preview", F.lit("")).alias("preview"))
    first = F.array_join(F.slice(F.array_sort(F.collect_set(label)), 1, most_children), ", ")
    up = rows.where("parent is not null").groupBy("parent").agg(F.sum("support").alias("support"), first.alias("preview"))
    above = up.select(F.col("parent").alias("node"), F.lit("parent").alias("kind"), "parent", "support", "preview")
    return own.union(above).select("node", "kind", "parent", "support", F.log1p("support").alias("size"), "preview")
