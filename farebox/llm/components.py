"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farebox.llm.common import scratch


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of every node of ``links(a, b)``.

    Each round makes every node's larger neighbours, then its smaller ones,
    point at the smallest of its neighbourhood (two grouped minima and two
    joins). Rounds are logarithmic in the longest chain; the last one changes
    nothing, so links that point at their smallest already take one. Each round's
    links go to a shared scratch table, so lineage doesn't grow.
    """
    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = scratch(edges, "edges", small_rows=True)
    before = state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = (both.where("v > u").join(lowest, "u")
                 .select(F.col("v").alias("u"), F.col("low").alias("v")).where("u != v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = (large.join(low, "u")
                 .select(F.col("v").alias("u"), F.col("low").alias("v"))
                 .unionByName(low.select("u", F.col("low").alias("v")))
                 .where("u != v").distinct())
        edges = scratch(small, "edges", small_rows=True)
        now = state(edges)
        if now == before:
            break
        before = now
    component = edges.groupBy("u").agg(F.min("v").alias("component"))
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    return scratch(nodes.join(component, F.col("node") == F.col("u"), "left")
                   .select("node", F.coalesce("component", "node").alias("component")), "components", small_rows=True)
