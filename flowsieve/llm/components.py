"""Connected components over an edge table, as rounds of joins on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from flowsieve.session import cut, cut_counted


def _stars(edges: DataFrame, large: bool) -> tuple[DataFrame, int, int]:
    """One step: neighbours of a node are linked to the smallest of them (or to the node itself).

    The large step moves only larger neighbours, the small step only smaller ones. Every step
    keeps the components. Returns the new edges (u > v), how many of them are new, and how many there are.
    """
    seen = edges.select("u", "v")
    if large:
        seen = seen.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(seen.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    moved = seen.where("v > u") if large else seen
    linked = moved.join(least, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
    if not large:
        linked = linked.unionByName(least.select("u", F.col("m").alias("v")))
    new = linked.where("u <> v").groupBy("u", "v").agg(F.lit(0).alias("new"))
    old = edges.select("u", "v").withColumn("old", F.lit(0))
    both = new.join(old, ["u", "v"], "left")
    seen = Observation()
    fresh = F.count_if(F.col("old").isNull()).alias("fresh")
    table = cut(both.select("u", "v", "old").observe(seen, F.count(F.lit(1)).alias("rows"), fresh))
    return table, seen.get["fresh"], seen.get["rows"]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b): the smallest node reachable.

    Large-star and small-star steps alternate until neither makes a new edge; about log n rounds,
    also on long chains. Each step is a grouped minimum and one join whose hot keys adaptive
    execution can split; nothing comes to the driver but the number of new edges. Self-links and
    links with null are ignored, so a node that has no other link is not in the result.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now, rows = cut_counted(pairs.distinct())
    while rows:
        now, grown, _ = _stars(now, large=True)
        now, more, left = _stars(now, large=False)
        if grown == 0 and more == 0 and left == rows:
            break
        rows = left
    root = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return root.unionByName(roots)
