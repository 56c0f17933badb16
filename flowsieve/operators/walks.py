"""Walks through block graphs that end where their conditions contradict each other.

A walk carries what its branches have asked of each variable: an interval of whole numbers and the
constants taken out of it. An edge adds its conditions, a block that writes a variable forgets what was
asked of it; a walk whose interval runs empty is not followed. They are followed inside the task that has the
links of their unit (``roam``), what a task may not finish goes on in others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.operators.inside import FACT, LINK, group_rows
from flowsieve.operators.paths import MAX_LOOP
from flowsieve.operators.roam import EDGE, KNOWN, OPEN, STATE, RoamStates, RoamWalks
from flowsieve.session import cut, cut_counted, ship

ASKED = "array<struct<var: string, lo: bigint, hi: bigint, holes: array<bigint>>>"
CONDITIONS = "array<struct<var: string, cmp: string, const: bigint>>"
#: Open walks of a part.
PART_WALKS = 1_000


def _nothing(shape: str) -> Column:
    return F.array().cast(shape)


def _meet(asked: Column, condition: Column) -> Column:
    """``asked`` after one more condition; holes at the ends of an interval are cut off it, so equal sets look equal."""
    var, cmp, const = condition["var"], condition["cmp"], condition["const"]
    mine = F.filter(asked, lambda a: a["var"] == var)
    before = F.get(mine, 0)
    low = F.when(cmp.isin("=", ">="), const).when(cmp == ">", const + 1)
    high = F.when(cmp.isin("=", "<="), const).when(cmp == "<", const - 1)
    low, high = F.greatest(before["lo"], low), F.least(before["hi"], high)
    old = F.coalesce(before["holes"], _nothing("array<bigint>"))
    holes = F.array_sort(F.when(cmp == "!=", F.array_union(old, F.array(const))).otherwise(old))
    low = F.aggregate(holes, low, lambda end, hole: F.when(hole == end, end + 1).otherwise(end))
    high = F.aggregate(F.reverse(holes), high, lambda end, hole: F.when(hole == end, end - 1).otherwise(end))
    inside = F.filter(holes, lambda h: F.coalesce(h > low, F.lit(True)) & F.coalesce(h < high, F.lit(True)))
    new = F.struct(var.alias("var"), low.alias("lo"), high.alias("hi"), inside.alias("holes"))
    others = F.filter(asked, lambda a: a["var"] != var)
    usable = cmp.isin(*KNOWN) & const.isNotNull() & var.isNotNull()
    return F.when(usable, F.array_sort(F.array_append(others, new))).otherwise(asked)


def _possible(asked: Column) -> Column:
    return ~F.coalesce(F.exists(asked, lambda a: a["lo"] > a["hi"]), F.lit(False))


def _links(edges: DataFrame, conditions: DataFrame, writes: DataFrame | None) -> DataFrame:
    """(unit, block, to, conditions, open, forgotten), one row per edge."""
    met = conditions.groupBy("unit", "src", "dst").agg(
        F.collect_list(F.struct(F.col("var").cast("string").alias("var"), "cmp", F.col("const").cast("bigint").alias("const"))).alias("conditions")
    )
    links = edges.select("unit", "src", "dst").distinct().join(met, ["unit", "src", "dst"], "left")
    if writes is None:
        links = links.withColumn("forgotten", _nothing("array<string>"))
    else:
        written = writes.groupBy("unit", F.col("block").alias("dst")).agg(F.collect_set(F.col("var").cast("string")).alias("forgotten"))
        links = links.join(written, ["unit", "dst"], "left")
    conditions = F.coalesce("conditions", _nothing(CONDITIONS))
    asks = lambda c: c["cmp"].isNotNull() & (c["cmp"] != "true")
    unknown = F.exists(conditions, lambda c: asks(c) & ~F.coalesce(c["cmp"].isin(*KNOWN) & c["const"].isNotNull(), F.lit(False)))
    return cut(
        links.select(
            "unit", F.col("src").alias("block"), F.col("dst").alias("_to"), conditions.alias("_conditions"), unknown.alias("_open"),
            F.coalesce("forgotten", _nothing("array<string>")).alias("_forgotten"),
        )
    )


def _step(front: DataFrame, links: DataFrame) -> DataFrame:
    """Every possible step from ``front``: ``_to`` and ``_asked`` are where it leads."""
    after = F.aggregate("_conditions", F.col("asked"), _meet)
    tried = front.join(links, ["unit", "block"]).withColumn("_asked", after).where(_possible(F.col("_asked")))
    kept = F.filter("_asked", lambda a: ~F.array_contains("_forgotten", a["var"]))
    return tried.withColumn("_asked", kept).withColumn("imprecise", F.col("imprecise") | F.col("_open"))


def _task_rows(front: DataFrame, links: DataFrame) -> DataFrame:
    """``front(unit, _part, block, asked, imprecise, ...)`` and the links of their parts, dealt and sorted for ``roam``."""
    links = links.where("unit IS NOT NULL AND block IS NOT NULL")
    links = links.select(
        "unit", F.col("_part") if "_part" in links.columns else F.lit(0).alias("_part"), F.lit(LINK).cast("byte").alias("_kind"), "block", "_to",
        F.to_json("_conditions").alias("_conditions"), F.to_json("_forgotten").alias("_forgotten"), F.col("_open").alias("imprecise"),
    )
    both = front.withColumn("_kind", F.lit(FACT).cast("byte")).unionByName(links, allowMissingColumns=True)
    return both.repartition("unit", "_part").sortWithinPartitions("unit", "_part")


def _same_unit(table: DataFrame, units: DataFrame, how: str) -> DataFrame:
    return table.join(units.select(F.col("unit").alias("_unit")), F.col("unit").eqNullSafe(F.col("_unit")), how)


def feasible_walks(
    edges: DataFrame,
    entries: DataFrame,
    conditions: DataFrame,
    writes: DataFrame | None = None,
    max_loop: int = MAX_LOOP,
    max_rows: int | None = None,
    separator: str | None = None,
) -> DataFrame:
    """All walks from an entry that enter each block at most ``max_loop`` times and don't contradict themselves.

    ``edges(unit, src, dst)``, ``entries(unit, block)``, ``conditions(unit, src, dst, var, cmp, const)`` those an edge adds,
    ``writes(unit, block, var)``. Gives step, unit, path (its blocks; the walk it goes on from is the path without the last one),
    block (the last one), asked (variable, interval, holes), imprecise (a condition on the way could not be read; it is left out),
    stopped (the bound ended the walk here). With a ``separator`` the path is one text, made in the task. Walks are followed inside the task that has the links of their unit; a unit with more
    walks than a task may follow is dealt to several tasks by its walks so far, round by round. There may be exponentially many: above
    ``max_rows`` in one step an error says how many there are, before they are followed, which takes a round for every
    step; ``feasible_states`` answers most questions without listing walks.
    """
    spark = edges.sparkSession
    ship(spark)
    links = _links(edges, conditions, writes)
    kind = dict(links.dtypes)["block"]
    start = entries.select("unit", F.array(F.col("block").cast(kind)).alias("path"), F.lit("[]").alias("asked"), F.lit(False).alias("imprecise"))
    front, rows = cut_counted(start)
    near = links
    shape = f"unit {dict(links.dtypes)['unit']}, path array<{kind}>, _text string, step int, block {kind}, asked string, imprecise boolean, stopped boolean, _open boolean"
    task = RoamWalks(group_rows(links), max_loop, None if max_rows is None else 1, separator)
    found, step = [], 0
    while rows or not found:
        if max_rows is not None and rows > max_rows:
            raise ValueError(f"{rows} walks of {step} steps; allowed are {max_rows}")
        # a unit of which much is open is many parts, each with the links of the unit
        size = front.groupBy("unit").agg(F.ceil(F.count(F.lit(1)) / PART_WALKS).cast("int").alias("_parts")).where("_parts > 1")
        size, large = cut_counted(size) if rows > PART_WALKS else (size, 0)
        part = F.lit(0)
        if large:
            parts = size.select("unit", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
            near = links.join(parts, "unit", "left").withColumn("_part", F.coalesce("_part", F.lit(0)))
            front = front.join(size, "unit", "left")
            part = F.pmod(F.xxhash64("path"), F.coalesce("_parts", F.lit(1))).cast("int")
        if step:
            near = near.join(front.select("unit").distinct(), "unit", "left_semi")
        dealt = front.select("unit", part.alias("_part"), F.element_at("path", -1).alias("block"), "path", "asked", "imprecise")
        walked, rows = cut_counted(_task_rows(dealt, near).mapInArrow(task, shape), F.col("_open"))
        found.append(walked.where("NOT _open"))
        front, near = walked.where("_open").select("unit", "path", "asked", "imprecise"), links
        step += 1
    return _all(found).select(
        "step", "unit", "block", F.from_json("asked", ASKED).alias("asked"), "imprecise", "stopped",
        F.col("path" if separator is None else "_text").alias("path"),
    )


def walk_texts(walks: DataFrame, separator: str = ">") -> DataFrame:
    """``walks`` with ``path`` as one text, for reports."""
    return walks.withColumn("path", F.array_join(F.col("path").cast("array<string>"), separator))


@dataclass
class FeasibleGraph:
    """What feasible walks make of a block graph: ``states(unit, block, asked, imprecise)`` and ``edges(unit, src, dst)``."""

    states: DataFrame
    edges: DataFrame

    def blocks(self) -> DataFrame:
        return self.states.select("unit", "block").distinct()

    def keep(self, rows: DataFrame) -> DataFrame:
        """Rows (of seeds, instructions, ...) of blocks that some feasible walk enters."""
        return rows.join(self.blocks(), ["unit", "block"], "left_semi")


def feasible_states(edges: DataFrame, entries: DataFrame, conditions: DataFrame, writes: DataFrame | None = None) -> FeasibleGraph:
    """The blocks, edges and states of all feasible walks of any length.

    Two walks that come to the same block having asked the same go on in the same way, so only one of them is
    followed. The number of states is finite, as intervals end at constants of the conditions, so loops need no
    bound: a block is entered again only by a walk that asks something new. A state is imprecise if some walk to it is.
    A unit is followed inside a task; with more links or states than a task may have (``flowsieve.rows.per.group``), step by step.
    """
    spark = edges.sparkSession
    ship(spark)
    links = _links(edges, conditions, writes)
    kinds, limit = dict(links.dtypes), group_rows(links)
    start = entries.select("unit", F.col("block").cast(kinds["block"]).alias("block"), F.lit("[]").alias("asked"), F.lit(False).alias("imprecise")).distinct()
    sized = links.groupBy("unit").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    large, any_large = cut_counted(sized.select("unit"))
    shape = f"unit {kinds['unit']}, _kind byte, block {kinds['block']}, _to {kinds['block']}, asked string, imprecise boolean"
    here, near = (_same_unit(start, large, "left_anti"), _same_unit(links, large, "left_anti")) if any_large else (start, links)
    rows = _task_rows(here.withColumn("_part", F.lit(0)), near)
    found, left = cut_counted(rows.mapInArrow(RoamStates(limit), shape), F.col("_kind") == OPEN)
    known = found.where(F.col("_kind") == STATE).select("unit", "block", F.from_json("asked", ASKED).alias("asked"), "imprecise")
    taken = found.where(F.col("_kind") == EDGE).select("unit", F.col("block").alias("src"), F.col("_to").alias("dst"))
    if not any_large and not left:
        return FeasibleGraph(known, taken)
    front = found.where(F.col("_kind") == OPEN).select("unit", "block", "asked", "imprecise")
    if any_large:
        front = front.unionByName(_same_unit(start, large, "left_semi"))
    return _step_by_step(front.withColumn("asked", F.from_json("asked", ASKED)), links, known, taken)


def _step_by_step(front: DataFrame, links: DataFrame, known: DataFrame, taken: DataFrame) -> FeasibleGraph:
    """``known`` states and ``taken`` edges with what goes on from ``front``, whose states are new; a step is a join."""
    keys = ["unit", "block", "asked", "imprecise"]
    front, rows = cut_counted(front)
    known, taken = [known, front], [taken]
    while rows:
        tried = cut(_step(front, links).select("unit", F.col("block").alias("src"), F.col("_to").alias("block"), F.col("_asked").alias("asked"), "imprecise"))
        taken.append(tried.select("unit", "src", F.col("block").alias("dst")).distinct())
        # whole groups only: a unit without a walk on the move is not compared again
        seen = _all(known).join(tried.select("unit").distinct(), "unit", "left_semi")
        front, rows = cut_counted(tried.select(*keys).distinct().join(seen, keys, "left_anti"))
        known.append(front)
        if len(known) > 6:
            known, taken = [cut(_all(known))], [cut(_all(taken).distinct())]
    states = _all(known).groupBy("unit", "block", "asked").agg(F.bool_or("imprecise").alias("imprecise"))
    return FeasibleGraph(cut(states), cut(_all(taken).distinct()))


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
