"""Connected components of large edge lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import heavy_keys, spread_join, staged


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """id, component (the smallest id reachable) for every id in edges (a, b: bigint).

    Every round gives each node the smallest label among its neighbours and its
    label's own label (pointer jumping), so paths halve.  Rounds end when no
    label changes.  Each round's labels are a table in the shared folder.  A node
    with very many neighbours, and a label with very many nodes, is dealt over
    several tasks.
    """
    most = 2 * edges.count()
    both = staged(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges", most)
    hubs = heavy_keys(both, "b")
    label = staged(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("p")), "label", most)
    for _ in range(rounds):
        heard = spread_join(both, label.select(F.col("id").alias("b"), "p"), "b", "a", hubs).select(F.col("a").alias("id"), "p", F.lit(None).cast("bigint").alias("old"))
        step = heard.union(label.select("id", "p", F.col("p").alias("old"))).groupBy("id").agg(F.min("p").alias("q"), F.max("old").alias("old"))
        up = label.select(F.col("id").alias("q"), F.col("p").alias("q_p"))
        # labels that many nodes have now are those that many will have
        fresh = staged(spread_join(step, up, "q", "id", heavy_keys(label, "p"), "left").select("id", "old", F.least("q", F.coalesce("q_p", "q")).alias("p")), "label")
        label = fresh.select("id", "p")
        if not fresh.where("p <> old").limit(1).count():
            return label.select("id", F.col("p").alias("component"))
    raise RuntimeError(f"labels still change after {rounds} rounds")
