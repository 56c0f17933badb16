"""Reachability, liveness, relevance and rewriting of block graphs.

Tables: ``edges(unit, src, dst)``, ``blocks(unit, block)``; all keys include the unit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.operators.ends import MERGE, RENAME, Trivial, dealt, follow_ends, split_by_size
from flowsieve.operators.fixpoint import follow_pointers, grow
from flowsieve.operators.ordered import add_range_slices, row_sequence
from flowsieve.operators.regions import reach
from flowsieve.operators.spread import WORD, breadth_first, flood, spread
from flowsieve.session import cut, cut_counted, ship


def _backward(edges: DataFrame) -> DataFrame:
    return edges.select("unit", F.col("dst").alias("block"), F.col("src").alias("_to"))


def reachable_blocks(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Blocks reached from the entries, with their breadth-first level."""
    return breadth_first(entries, edges)


def covered_edges(edges: DataFrame, reached: DataFrame, feasible: DataFrame) -> DataFrame:
    """Edges followed once: the source is reached and a branch target is feasible.

    Plain jumps (label ``target``) are followed whatever the target's state.
    """
    followed = edges.join(reached.select("unit", F.col("block").alias("src")), ["unit", "src"], "left_semi")
    ok = feasible.select("unit", F.col("block").alias("dst"), F.lit(True).alias("_ok")).distinct()
    return (
        followed.join(ok, ["unit", "dst"], "left")
        .where((F.col("label") == "target") | F.col("_ok").isNotNull())
        .select("unit", "src", "dst", "label")
        .distinct()
    )


def reachable_units(calls: DataFrame, roots: DataFrame) -> DataFrame:
    """Call closure: ``calls(unit, callee)`` from ``roots(unit)``, with the call depth."""
    return reach(calls, roots)


def live_variables(mentions: DataFrame, edges: DataFrame) -> DataFrame:
    """live(b) = variables mentioned in b, united with live(successors); nothing is killed."""
    return spread(mentions, edges, ["var"], backward=True)


def live_variables_interproc(
    mentions: DataFrame, edges: DataFrame, calls: DataFrame, roots: DataFrame, includes: DataFrame | None = None
) -> DataFrame:
    """Liveness of the units that calls and includes reach from ``roots``; both have unit and callee.

    Variables belong to their unit, so a call or include makes the callee's blocks live in its
    own variables; nothing of them becomes live in the caller. ``includes`` come from
    ``link_includes``; one without a known target has a null callee and leads nowhere.
    """
    links = calls.select("unit", "callee")
    if includes is not None:
        links = links.unionByName(includes.select("unit", "callee").where("callee IS NOT NULL"))
    reached = cut(reachable_units(links, roots).select("unit"))
    return live_variables(
        mentions.join(reached, "unit", "left_semi"), edges.join(reached, "unit", "left_semi")
    )


def sink_relevance(sink_blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """Blocks that hold a sink or lead to such a block: least fixpoint from the sinks."""
    return spread(sink_blocks, edges, [], backward=True)


def prune_dead_blocks(blocks: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Blocks without a live way from the entry are dropped."""
    return blocks.join(reachable_blocks(edges, entries), ["unit", "block"], "left_semi")


def order_blocks(levels: DataFrame) -> DataFrame:
    """Breadth-first block numbers from 1, by level and then by name."""
    order = ["level", "block"]
    numbered = row_sequence(add_range_slices(levels, order), ["unit"], order, "number")
    return numbered.select("unit", "block", "level", "number")


def state_delta(new: DataFrame, old: DataFrame) -> DataFrame:
    """Entry states that were not there in the last round; empty means at rest."""
    return new.exceptAll(old)


def contract_pass_through(edges: DataFrame, passing: DataFrame) -> DataFrame:
    """Bypass blocks that hold only a jump; ``passing(unit, block)`` names them.

    Edges into such a block go to the end of its chain, its own edge disappears.
    A block that jumps to itself stays, and so does a chain that runs in a circle.
    """
    gate = passing.select("unit", F.col("block").alias("src"), F.lit(True).alias("_pass"))
    jump = edges.select("unit", "src", "dst").join(gate, ["unit", "src"]).where("src <> dst").drop("_pass")
    onward = jump.select("unit", F.col("src").alias("dst"), F.lit(True).alias("_again"))
    nodes = jump.join(onward, ["unit", "dst"], "left").select(
        "unit", F.col("src").alias("block"), F.when(F.col("_again"), F.col("dst")).alias("next"), F.col("dst").alias("final")
    )
    ends = follow_pointers(nodes, ["unit", "block"], "next", {"final": lambda mine, theirs: F.coalesce(theirs, mine)})
    removed = cut(ends.where("next IS NULL").select("unit", F.col("block").alias("_gone"), "final"))
    kept = edges.select("unit", "src", "dst").join(
        removed.select("unit", F.col("_gone").alias("src")), ["unit", "src"], "left_anti"
    )
    return (
        kept.join(removed.withColumnRenamed("_gone", "dst"), ["unit", "dst"], "left")
        .select("unit", "src", F.coalesce("final", "dst").alias("dst"))
        .distinct()
    )


def removable_merge_blocks(passing: DataFrame, edges: DataFrame, merges: DataFrame) -> DataFrame:
    """Of the jump-only blocks those without merges, or whose merges all feed the next block's.

    ``merges(unit, block, result, operand)``.
    """
    owned = merges.select("unit", "block", "result").distinct()
    following = edges.select("unit", F.col("src").alias("block"), F.col("dst").alias("_next"))
    used = merges.select("unit", F.col("block").alias("_next"), F.col("operand").alias("result")).distinct()
    unused = (
        owned.join(passing, ["unit", "block"], "left_semi")
        .join(following, ["unit", "block"])
        .join(used, ["unit", "_next", "result"], "left_anti")
    )
    return passing.join(unused, ["unit", "block"], "left_anti")


def lift_merge_operands(merges: DataFrame, removed: DataFrame) -> DataFrame:
    """Merges of removed blocks disappear; where they were operands, theirs take the place."""
    gone = merges.join(removed, ["unit", "block"], "left_semi")
    kept = merges.join(removed, ["unit", "block"], "left_anti").select("unit", "block", "result", "operand")
    inner = gone.select("unit", F.col("result").alias("operand"), F.col("operand").alias("_inner"))
    spread = grow(
        kept,
        lambda delta: delta.join(inner, ["unit", "operand"]).select(
            "unit", "block", "result", F.col("_inner").alias("operand")
        ),
        ["unit", "block", "result", "operand"],
        within=["unit"],
    )
    names = gone.select("unit", F.col("result").alias("operand"))
    return spread.join(names, ["unit", "operand"], "left_anti").where("operand <> result").distinct()


def eliminate_trivial_merges(merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace merges with one operand by it, again and again, everywhere.

    Takes ``merges(unit, result, operand)``, gives the merges left and the renames
    ``(unit, result, target)``. Merges that only name each other keep a null target.
    The passes over a unit are made inside a task; those over a unit too large for it are joins.
    """
    ship(merges.sparkSession)
    small, large = split_by_size(cut(merges.select("unit", "result", "operand").where("operand <> result")))
    types = {f.name: f.dataType for f in small.schema.fields}
    shape = T.StructType([T.StructField(n, types.get(n, T.ByteType())) for n in ("unit", "_kind", "result", "operand")])
    found = cut(dealt(small).mapInArrow(Trivial(), shape))
    left = found.where(F.col("_kind") == MERGE).drop("_kind")
    renames = found.where(F.col("_kind") == RENAME).select("unit", "result", F.col("operand").alias("target"))
    if large is None:
        return left, renames
    more = _eliminate_by_joins(cut(large.distinct()))
    return left.unionByName(more[0]), renames.unionByName(more[1])


def _eliminate_by_joins(current: DataFrame) -> tuple[DataFrame, DataFrame]:
    renames = None
    while True:
        single = current.groupBy("unit", "result").agg(
            F.count(F.lit(1)).alias("_n"), F.min("operand").alias("operand")
        )
        trivial, rows = cut_counted(single.where("_n = 1").select("unit", "result", "operand"))
        if rows == 0:
            empty = current.select("unit", "result", F.col("operand").alias("target")).limit(0)
            return current, renames if renames is not None else empty
        names = trivial.select("unit", F.col("result").alias("operand"), F.lit(True).alias("_again"))
        nodes = trivial.join(names, ["unit", "operand"], "left").select(
            "unit", "result", F.when(F.col("_again"), F.col("operand")).alias("next"), F.col("operand").alias("target")
        )
        ends = follow_pointers(nodes, ["unit", "result"], "next", {"target": lambda mine, theirs: F.coalesce(theirs, mine)})
        found = cut(ends.select("unit", "result", F.when(F.col("next").isNull(), F.col("target")).alias("target")))
        renames = found if renames is None else cut(_renamed(renames, found, "target").unionByName(found))
        left = current.join(trivial, ["unit", "result"], "left_anti")
        current = cut(
            _renamed(left, found, "operand").where("operand IS NOT NULL AND operand <> result").distinct()
        )


def _renamed(table: DataFrame, renames: DataFrame, column: str) -> DataFrame:
    to = renames.select("unit", F.col("result").alias(column), F.col("target").alias("_to"), F.lit(True).alias("_hit"))
    new = F.when(F.col("_hit"), F.col("_to")).otherwise(F.col(column)).alias("_new")
    others = [c for c in table.columns if c not in ("unit", column)]
    joined = table.join(to, ["unit", column], "left").select("unit", *others, new)
    return joined.withColumnRenamed("_new", column).select(*table.columns)


def place_merges(
    reads: DataFrame, defs: DataFrame, edges: DataFrame, bits: int = WORD
) -> DataFrame:
    """Merge operands ``(unit, block, var, operand)`` that the reads ask for.

    ``reads`` are reads that no write of their own block precedes; ``defs`` the blocks
    that write a variable. A block without its own write passes the question to its
    predecessors; with several of them it gets a merge named ``merge:<block>``, whose
    operands are what reaches the end of each predecessor, itself left out. An operand
    is the block that wrote it, another merge, or null where nothing was written.
    """
    keys = ["unit", "block", "var"]
    back = cut(_backward(edges).distinct())
    written = cut(defs.select(*keys).distinct())
    asking = back.select("unit", F.col("block").alias("src"), F.col("_to").alias("dst"))
    asked = cut(flood(reads, asking, written, ["var"], bits=bits))
    parents = back.groupBy("unit", "block").agg(F.count(F.lit(1)).alias("_n"), F.min("_to").alias("_one"))
    asked = cut(asked.join(parents, ["unit", "block"], "left").withColumn("_n", F.coalesce("_n", F.lit(0))))
    # what reaches the end of a predecessor: its own write, else what enters it
    entering = asked.select(
        *keys,
        F.when(F.col("_n") > 1, F.concat(F.lit("merge:"), F.col("block"))).alias("value"),
        F.when(F.col("_n") == 1, F.col("_one")).alias("_from"),
    )
    own = written.select("unit", F.col("block").alias("_from"), "var", F.col("block").alias("_written"))
    nodes = entering.join(own, ["unit", "_from", "var"], "left").select(
        "unit",
        "var",
        "block",
        F.when(F.col("_written").isNull(), F.col("_from")).alias("next"),
        F.coalesce("value", "_written").alias("value"),
    )
    settled = follow_ends(nodes, ["unit", "var", "block"], "next", ["value"])
    entry = settled.select("unit", F.col("block").alias("_to"), "var", F.col("value").alias("_entry"))
    merging = asked.where("_n > 1").select(*keys)
    operands = (
        merging.join(back, ["unit", "block"])
        .join(own.withColumnRenamed("_from", "_to"), ["unit", "_to", "var"], "left")
        .join(entry, ["unit", "_to", "var"], "left")
        .select(*keys, F.coalesce("_written", "_entry").alias("operand"))
        .distinct()
    )
    itself = F.concat(F.lit("merge:"), F.col("block"))
    return operands.where(F.col("operand").isNull() | (F.col("operand") != itself))
