"""Taint with sanitizers over block graphs whose variables are written more than once.

A block is a function on states. What it does to a variable is one of three things: it
*generates* taint (a source writes it), *kills* it (anything else writes it), or *keeps*
it. A write that copies is a kill plus a transfer from the variable that is read. Along a way the
sanitizers met are united, over several ways only those stay that lie on all of them; so
a transfer is ``mask & ~clears``, two in a row unite their ``clears``, two side by side
intersect them. The functions of a block are composed first, then facts run over the graph.

``steps(unit, block, seq, kind, var, to_var, clears)`` lists what is read and written, a row
per pair of them: ``kind`` is ``source``, ``clean`` or ``copy``; ``var`` is null where nothing
is read, ``to_var`` where nothing is written; ``clears`` has the bits of the sanitizers that the
instruction applies, null for none. ``seq`` orders a block's instructions, each with all of its
reads before its writes; several writers of a variable at one ``seq`` are merged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.operators.inside import deal_large_units, follow
from flowsieve.operators.links import link_accesses
from flowsieve.operators.ordered import with_slice
from flowsieve.operators.taint import ALL_OPEN
from flowsieve.session import cut, cut_counted

PLACE = ["unit", "block"]


def linked_steps(steps: DataFrame) -> DataFrame:
    """``steps`` with the last earlier write of what is read, inside the block, as ``def_seq`` (null: none)."""
    coarse = with_slice(steps)
    steps = cut(steps.withColumn("clears", F.coalesce("clears", F.lit(0).cast("bigint"))))
    reads = steps.where("var IS NOT NULL").withColumn("is_write", F.lit(0))
    writes = steps.where("to_var IS NOT NULL").select(*PLACE, *coarse, "seq", F.col("to_var").alias("var")).distinct()
    both = reads.unionByName(writes.withColumn("is_write", F.lit(1)), allowMissingColumns=True)
    linked = link_accesses(both, [*PLACE, "var"])
    return linked.unionByName(steps.where("var IS NULL").withColumn("def_seq", F.lit(None).cast(dict(linked.dtypes)["def_seq"])))


def resolve_definitions(linked: DataFrame) -> DataFrame:
    """Where each written value comes from: (unit, block, seq, to_var, var, clears), a row per origin.

    ``var`` is a variable as the block's entry had it, or null for a source inside the block. A value without
    a row is clean. Values are followed through the block by composing links with links, so a chain of n
    copies takes log n rounds; ways to the same origin are merged in each round.
    """
    written = linked.where("to_var IS NOT NULL AND kind <> 'clean' AND (kind = 'source' OR var IS NOT NULL)")
    source = F.col("kind") == "source"
    links = written.select(
        *PLACE,
        "seq",
        "to_var",
        F.when(~source, F.col("var")).alias("var"),
        F.when(~source, F.col("def_seq")).alias("via"),
        "clears",
    )
    one = [*PLACE, "seq", "to_var", "var", "via"]
    current, open_rows = cut_counted(links.groupBy(*one).agg(F.bit_and("clears").alias("clears")), F.col("via").isNotNull())
    while open_rows:
        onward = current.select(
            *PLACE, F.col("seq").alias("via"), F.col("to_var").alias("var"),
            F.col("var").alias("_var"), F.col("via").alias("_via"), F.col("clears").alias("_clears"),
        )
        moved = current.where("via IS NOT NULL").join(onward, [*PLACE, "via", "var"]).select(
            *PLACE, "seq", "to_var", F.col("_var").alias("var"), F.col("_via").alias("via"),
            F.col("clears").bitwiseOR(F.col("_clears")).alias("clears"),
        )
        merged = current.where("via IS NULL").unionByName(moved).groupBy(*one).agg(F.bit_and("clears").alias("clears"))
        current, open_rows = cut_counted(merged, F.col("via").isNotNull())
    return current.drop("via")


def block_functions(steps: DataFrame, origins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(transfers, kills) of whole blocks: (unit, block, var, to_var, clears), (unit, block, var).

    A transfer says what a variable holds at the block's end, from one at its entry; with null ``var`` it is
    generated in the block.
    """
    last = steps.where("to_var IS NOT NULL").groupBy(*PLACE, "to_var").agg(F.max("seq").alias("seq"))
    transfers = origins.join(last, [*PLACE, "seq", "to_var"]).drop("seq")
    return transfers, last.select(*PLACE, F.col("to_var").alias("var"))


def taint_block_states(steps: DataFrame, edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(unit, block, var, open_mask) of what is tainted at the entry of a block.

    ``open_mask`` has a bit for each sanitizer that some tainted flow avoids, so a sanitizer counts as applied
    where its bit is missing. Writes kill what the variable had before; cycles are followed until
    nothing is gained. ``seeds(unit, block, var, open_mask)`` are tainted at an entry from outside. Blocks
    without steps pass everything on; edges of blocks that don't occur elsewhere do no harm.
    """
    return states_of(*block_functions(steps, resolve_definitions(linked_steps(steps))), edges, seeds)


def states_of(transfers: DataFrame, kills: DataFrame, edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """``taint_block_states`` from the functions of the blocks."""
    transfers = cut(transfers)
    links = cut(edges.select("unit", F.col("src").alias("block"), F.col("dst").alias("_to")).distinct())
    keys = [*PLACE, "var"]
    made = transfers.where("var IS NULL").select(
        *PLACE, F.col("to_var").alias("var"), F.expr(f"{ALL_OPEN}L & ~clears").alias("open_mask")
    )
    start = made.join(links, PLACE).select("unit", F.col("_to").alias("block"), "var", "open_mask")
    if seeds is not None:
        start = start.unionByName(seeds.select(*keys, "open_mask"))
    copies = transfers.where("var IS NOT NULL")
    return follow(start, links, ["var"], "open_mask", copies=copies, kills=kills.select(*keys), deal=deal_large_units(links, copies))


def read_states(linked: DataFrame, origins: DataFrame, entry: DataFrame) -> DataFrame:
    """State of what each step reads: (unit, block, seq, var, open_mask), only what is tainted.

    ``linked``, ``origins`` and ``entry`` are the results of ``linked_steps``, ``resolve_definitions`` and ``states_of``.
    """
    keys = [*PLACE, "var"]
    reads = linked.where("var IS NOT NULL").select(*PLACE, "seq", "var", "def_seq").distinct()
    made = origins.select(
        *PLACE, F.col("seq").alias("def_seq"), F.col("to_var").alias("var"), F.col("var").alias("_from"), "clears"
    )
    inside = reads.where("def_seq IS NOT NULL").join(made, [*PLACE, "def_seq", "var"])
    generated = inside.where("_from IS NULL").select(*PLACE, "seq", "var", F.expr(f"{ALL_OPEN}L & ~clears").alias("open_mask"))
    held = entry.select(*PLACE, F.col("var").alias("_from"), "open_mask")
    handed = inside.where("_from IS NOT NULL").join(held, [*PLACE, "_from"]).select(
        *PLACE, "seq", "var", F.expr("open_mask & ~clears").alias("open_mask")
    )
    direct = reads.where("def_seq IS NULL").join(entry, keys).select(*PLACE, "seq", "var", "open_mask")
    every = generated.unionByName(handed).unionByName(direct)
    return every.groupBy(*PLACE, "seq", "var").agg(F.bit_or("open_mask").alias("open_mask"))
