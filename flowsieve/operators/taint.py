"""Propagation of taint over def-use links, block graphs and calls."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.expressions import render_message
from flowsieve.operators.classify import classify_sinks, match_sink_arguments, sanitizer_mismatch
from flowsieve.operators.ends import follow_ends
from flowsieve.operators.fixpoint import follow_pointers, grow, grow_masks
from flowsieve.operators.inside import deal_large_units, follow
from flowsieve.operators.states import dedupe_findings
from flowsieve.session import cut

MASK_BITS = 62
ALL_OPEN = (1 << MASK_BITS) - 1


def straight_line_taint(ops: DataFrame) -> DataFrame:
    """Taint of each op's value where an op reads one earlier op.

    ``ops(unit, seq, def_seq, is_source, is_clean)``. A sanitizer is untainted, also if its name is
    a source's as well, a source is tainted, any other op takes over its definition's state; no
    definition -> untainted.
    Chains are followed to their end inside the task that has the unit.
    """
    nodes = ops.select(
        "unit",
        "seq",
        F.when(~F.col("is_source") & ~F.col("is_clean"), F.col("def_seq")).alias("parent"),
        F.when(F.col("is_clean"), F.lit(False))
        .when(F.col("is_source"), F.lit(True))
        .when(F.col("def_seq").isNull(), F.lit(False))
        .alias("tainted"),
    )
    done = follow_ends(nodes, ["unit", "seq"], "parent", ["tainted"])
    return done.select("unit", "seq", F.coalesce("tainted", F.lit(False)).alias("tainted"))


def straight_line_sanitizers(ops: DataFrame) -> DataFrame:
    """Strict form: a conditional sanitizer keeps the taint and is remembered.

    As ``straight_line_taint`` plus ``clears``, a bit per conditional sanitizer; gives
    tainted and ``open_mask``, the sanitizers NOT met on the way.
    """
    nodes = ops.select(
        "unit",
        "seq",
        F.when(~F.col("is_source") & ~F.col("is_clean"), F.col("def_seq")).alias("parent"),
        F.when(F.col("is_clean"), F.lit(False))
        .when(F.col("is_source"), F.lit(True))
        .when(F.col("def_seq").isNull(), F.lit(False))
        .alias("tainted"),
        F.expr(f"{ALL_OPEN}L & ~clears").alias("open_mask"),
    )
    done = follow_pointers(
        nodes,
        ["unit", "seq"],
        "parent",
        {
            "tainted": lambda mine, theirs: F.coalesce(mine, theirs),
            "open_mask": lambda mine, theirs: mine.bitwiseAND(F.coalesce(theirs, F.lit(ALL_OPEN))),
        },
    )
    return done.select("unit", "seq", F.coalesce("tainted", F.lit(False)).alias("tainted"), "open_mask")


def taint_fixpoint(seeds: DataFrame, flows: DataFrame) -> DataFrame:
    """Tainted ``(unit, var)`` over any flow graph, cycles included.

    ``flows(unit, var, to_unit, to_var)``: value copies inside and across units.
    """
    links = flows.select("unit", "var", "to_unit", "to_var")
    return grow(
        seeds,
        lambda delta: delta.join(links, ["unit", "var"]).select(
            F.col("to_unit").alias("unit"), F.col("to_var").alias("var")
        ),
        ["unit", "var"],
    )


def taint_strict(seeds: DataFrame, flows: DataFrame) -> DataFrame:
    """As ``taint_fixpoint``, keeping per variable the sanitizers some flow avoids.

    ``flows`` has ``clears`` as well. A sanitizer counts as applied when every flow
    meets it: its bit is then missing in ``open_mask``. The bits only grow.
    """
    start = seeds.select("unit", "var", F.lit(ALL_OPEN).alias("open_mask"))
    links = flows.select("unit", "var", "to_unit", "to_var", "clears")
    return grow_masks(
        start,
        lambda delta: delta.join(links, ["unit", "var"]).select(
            F.col("to_unit").alias("unit"),
            F.col("to_var").alias("var"),
            F.expr("open_mask & ~clears").alias("open_mask"),
        ),
        ["unit", "var"],
        "open_mask",
    )


def taint_blocks(generated: DataFrame, transfers: DataFrame, edges: DataFrame) -> DataFrame:
    """Tainted (unit, block, var) in graphs that are not in SSA form; nothing is killed.

    ``generated`` are sources, ``transfers(unit, block, var, to_var)`` the copies made
    inside a block, ``edges(unit, src, dst)`` carry every variable on.
    """
    links = cut(edges.select("unit", F.col("src").alias("block"), F.col("dst").alias("_to")).distinct())
    copies = cut(transfers.select("unit", "block", "var", "to_var", F.lit(0).alias("clears")))
    facts = generated.select("unit", "block", "var")
    return follow(facts, links, ["var"], copies=copies, within=True, deal=deal_large_units(links, copies))


def sanitizer_names(policy: DataFrame) -> list[str]:
    """Conditional sanitizers of a policy; their places are the bits of a mask."""
    listed = policy.where("kind = 'conditional_sanitizer'").select("name").distinct().limit(MASK_BITS + 1).collect()
    if len(listed) > MASK_BITS:
        raise ValueError(f"a mask holds at most {MASK_BITS} conditional sanitizers")
    return sorted(row["name"] for row in listed)


def sanitizer_words(policy: DataFrame) -> list[list[str]]:
    """All conditional sanitizers of a policy, in words of as many names as a mask has bits; at least one word."""
    names = sorted(r["name"] for r in policy.where("kind = 'conditional_sanitizer'").select("name").distinct().collect())
    return [names[k : k + MASK_BITS] for k in range(0, len(names), MASK_BITS)] or [[]]


def by_words(words: list[list[str]], state: Callable[[list[str]], DataFrame], keys: list[str]) -> DataFrame:
    """(keys, sanitizers) when a policy has more names than a mask has bits: one ``state`` per word, their names together.

    ``state`` takes the names of a word and gives keys and ``open_mask`` of what is tainted. Which keys
    these are does not depend on the names, so each word only adds to the lists.
    """
    found = None
    for k, names in enumerate(words):
        met = applied_sanitizers(names, F.col("open_mask"))
        part = cut(state(names).select(*keys, met.alias("sanitizers" if k == 0 else "_more")))
        if found is None:
            found = part
        else:
            found = found.join(part, keys).select(*keys, F.array_union("sanitizers", "_more").alias("sanitizers"))
    return found


def sanitizer_bit(names: list[str], name: Column) -> Column:
    """Bit of a sanitizer name, 0 for any other text or null."""
    bit = F.lit(0).cast("bigint")
    for place, known in enumerate(names):
        bit = F.when(name == known, F.lit(1 << place).cast("bigint")).otherwise(bit)
    return bit


def applied_sanitizers(names: list[str], open_mask: Column) -> Column:
    """Names whose bit is missing in the mask of what some flow avoids."""
    listed = F.array(*[F.lit(n) for n in names]).cast("array<string>")
    return F.filter(listed, lambda _, place: F.getbit(open_mask, place) == 0)


def find_flows(ops: DataFrame, arguments: DataFrame, policy: DataFrame, categories: DataFrame) -> DataFrame:
    """Findings before deduplication: watched, tainted, insufficiently sanitized arguments.

    ``arguments(unit, seq, pos, tainted, sanitizers)``.
    """
    sinks = classify_sinks(ops, policy)
    hits = sanitizer_mismatch(match_sink_arguments(sinks, arguments, ["unit", "seq"]))
    names = categories.select("category", "category_name")
    return hits.join(names, "category", "left").withColumn("message", render_message(F.col("category_name")))


def report_flows(
    ops: DataFrame, arguments: DataFrame, policy: DataFrame, categories: DataFrame, dedupe: str = "line"
) -> DataFrame:
    """One finding per (file, line), or per instruction with ``dedupe='op'``."""
    found = find_flows(ops, arguments, policy, categories)
    by = ["file", "start_line"] if dedupe == "line" else ["unit", "seq", "file", "start_line"]
    return dedupe_findings(found, by, [c for c in ("unit", "seq", "category", "message") if c not in by])
