"""Parts of a graph that isn't made of units, such as calls between all units of a corpus.

Neighbouring nodes grow together, level by level, until a region has as many rows as a task may hold. Only the links
decide, never the names. A way of thousands of steps then crosses few regions, each of which one task follows (``inside``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.operators.fixpoint import follow_pointers
from flowsieve.operators.inside import Deal, follow, group_rows
from flowsieve.session import cut, cut_counted


def regions(links: DataFrame, limit: int) -> DataFrame:
    """(node, region) for ``links(unit, callee)``, with at most ``limit`` rows (nodes and their links) in a region.

    In each level a region points to the neighbour of smallest hash, if that is smaller than its own; what points to
    one end becomes one region, unless it would be too large.
    """
    both = F.array(F.struct(F.col("unit").alias("node"), F.lit(2).alias("_rows")), F.struct(F.col("callee").alias("node"), F.lit(1).alias("_rows")))
    members = links.select(F.inline(both)).where("node IS NOT NULL").groupBy("node").agg(F.sum("_rows").alias("_rows"))
    members, count = cut_counted(members.withColumn("region", F.col("node")))
    near = F.array(F.struct(F.col("unit").alias("a"), F.col("callee").alias("b")), F.struct(F.col("callee").alias("a"), F.col("unit").alias("b")))
    edges = cut(links.where("unit <> callee").select(F.inline(near)).distinct())
    sizes = members.select("region", "_rows")
    level = 0
    while True:
        level += 1
        rank = lambda c: F.struct(F.xxhash64(F.lit(level), c), F.col(c))  # noqa: E731, B023
        lowest = edges.groupBy("a").agg(F.min(rank("b")).alias("_low")).where(F.col("_low") < rank("a"))
        lowest = lowest.select(F.col("a").alias("region"), F.col("_low")["b"].alias("next"))
        nodes = sizes.join(lowest, "region", "left").withColumn("root", F.when(F.col("next").isNull(), F.col("region")))
        ends = follow_pointers(nodes, ["region"], "next", {"root": lambda mine, theirs: F.coalesce(mine, theirs)})
        rooted = cut(sizes.join(ends.select("region", "root"), "region"))
        fitting = rooted.groupBy("root").agg(F.sum("_rows").alias("_sum")).where(F.col("_sum") <= limit)
        moved = rooted.join(fitting.select("root", F.lit(True).alias("_fits")), "root", "left")
        moved = cut(moved.select("region", F.when(F.col("_fits"), F.col("root")).otherwise(F.col("region")).alias("_new"), "_rows"))
        sizes, left = cut_counted(moved.groupBy(F.col("_new").alias("region")).agg(F.sum("_rows").alias("_rows")))
        to = moved.select("region", "_new")
        members = cut(members.join(to, "region").select("node", F.col("_new").alias("region")))
        ends_of = [to.select(F.col("region").alias(c), F.col("_new").alias(f"_{c}")) for c in ("a", "b")]
        edges = edges.join(ends_of[0], "a").join(ends_of[1], "b").where("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
        edges, between = cut_counted(edges.distinct())
        # a level that hardly joins anything more is the last one
        if not between or left > 0.9 * count:
            return members
        count = left


def reach(links: DataFrame, roots: DataFrame) -> DataFrame:
    """(unit, level): what ``links(unit, callee)`` lead to from ``roots(unit)``, with the least number of steps."""
    limit = group_rows(links)
    links, rows = cut_counted(links.select("unit", "callee").where("unit IS NOT NULL").distinct())
    deal: Deal | None = None
    if rows > limit:
        region = F.pmod(F.xxhash64("region"), F.lit(2**31 - 1)).cast("int").alias("_part")
        parts = cut(regions(links, limit).select(F.col("node").alias("_node"), region))

        def deal(df: DataFrame, block: str) -> DataFrame:
            return df.join(parts, F.col(block) == F.col("_node"), "left").drop("_node").withColumn("_part", F.coalesce("_part", F.lit(0)))

    whole = F.lit(0).alias("unit")
    start = roots.select(whole, F.col("unit").alias("block"), F.lit(0).cast("bigint").alias("level")).distinct()
    steps = links.select(whole, F.col("unit").alias("block"), F.col("callee").alias("_to"))
    found = follow(start, steps, [], "level", least=True, deal=deal)
    return found.select(F.col("block").alias("unit"), F.col("level").cast("int").alias("level"))
