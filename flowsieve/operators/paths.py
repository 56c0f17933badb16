"""Paths, the conditions on them, and what the conditions rule out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.expressions import negate_condition, symbol_of
from flowsieve.operators.fixpoint import follow_pointers
from flowsieve.operators.ordered import row_sequence, running_max, with_slice
from flowsieve.session import cut, cut_counted

MAX_LOOP = 10


#: Steps of a walk that one round follows; only walks that are longer are written and dealt out again.
ROUND = 6


def _unit_graphs(links: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per unit: the names of its blocks, and per block (by its place there) where its edges lead."""
    names = entries.select("unit", "block").unionByName(links.select("unit", "block")).unionByName(links.select("unit", F.col("_to").alias("block")))
    named = names.groupBy("unit").agg(F.array_sort(F.collect_set("block")).alias("_names"))
    targets = links.where("unit IS NOT NULL AND block IS NOT NULL").groupBy("unit", "block").agg(F.collect_list(F.struct("_to")).alias("_all"))
    edges = targets.groupBy(F.col("unit").alias("_unit")).agg(F.map_from_entries(F.collect_list(F.struct("block", "_all"))).alias("_targets"))
    place = F.map_from_arrays("_names", F.transform("_names", lambda _, at: at))
    both = named.join(edges, F.col("unit") == F.col("_unit"), "left").withColumn("_place", place)
    # a block without a name has place -1 and no edges
    at = lambda t: F.coalesce(F.try_element_at("_place", t["_to"]), F.lit(-1))
    ends = F.transform("_names", lambda n: F.transform(F.coalesce(F.try_element_at("_targets", n), F.array()), at))
    return cut(both.select(F.col("unit").alias("_unit"), "_names", ends.alias("_next")))


def _followed(front: DataFrame, graphs: DataFrame, max_loop: int, every: bool) -> DataFrame:
    """What follows on ``front`` within a round, each with the graph of its unit; ``_open`` are those a whole round on.

    The steps of a round are taken inside a task: a walk is replaced by its next steps, with ``every`` by itself, closed, as well.
    """
    often = lambda s: F.size("_path") - F.size(F.array_remove("_path", s))
    walks = front.join(graphs.hint("shuffle_hash"), F.col("unit").eqNullSafe(F.col("_unit")))
    walks = walks.drop("_unit").withColumn("_open", F.lit(True))
    closed = F.array(F.struct("_path", F.lit(False).alias("_open")))
    for _ in range(ROUND):
        onward = F.filter(F.get("_next", F.element_at("_path", -1)), lambda s: often(s) < max_loop)
        longer = F.transform(onward, lambda s: F.struct(F.array_append("_path", s).alias("_path"), F.lit(True).alias("_open")))
        if every:
            longer = F.when(F.col("_open"), F.concat(closed, F.coalesce(longer, F.slice(closed, 1, 0)))).otherwise(closed)
        walks = walks.select("unit", "_names", "_next", F.inline(longer))
    return walks.withColumn("imprecise", F.coalesce(F.exists(F.get("_next", F.element_at("_path", -1)), lambda s: often(s) >= max_loop), F.lit(False)))


def enumerate_paths(
    edges: DataFrame, entries: DataFrame, max_loop: int = MAX_LOOP, dead_ends: DataFrame | None = None
) -> DataFrame:
    """All block sequences from an entry that hold each block at most ``max_loop`` times.

    Gives every prefix with ``path`` (array), ``block`` (its end) and ``imprecise``
    (the bound stopped a step). ``dead_ends(unit, src, dst)`` are edges known to be
    infeasible; paths over them are not followed, which keeps the growth down.
    On the way a path is an array of small numbers, and only those that are a multiple of ``ROUND`` steps long
    are written; the others are made when the result is read.
    """
    links = edges.select("unit", F.col("src").alias("block"), F.col("dst").alias("_to")).distinct()
    if dead_ends is not None:
        no = dead_ends.select("unit", F.col("src").alias("block"), F.col("dst").alias("_to"))
        links = links.join(no, ["unit", "block", "_to"], "left_anti")
    entries = cut(entries.select("unit", "block"))
    graphs = _unit_graphs(links, entries)
    started = entries.join(graphs, F.col("unit").eqNullSafe(F.col("_unit")))
    place = F.coalesce(F.array_position("_names", F.col("block")) - 1, F.lit(-1)).cast("int")
    front, rows = cut_counted(started.select("unit", F.array(place).alias("_path")))
    every = None
    while rows or every is None:
        followed = _followed(front, graphs, max_loop, every=True)
        path = F.transform("_path", lambda at: F.get("_names", at)).alias("path")
        closed = followed.where("NOT _open").select("unit", path, "imprecise").select("unit", "path", F.element_at("path", -1).alias("block"), "imprecise")
        every = closed if every is None else every.unionByName(closed)
        front, rows = cut_counted(_followed(front, graphs, max_loop, every=False).select("unit", "_path"))
    return every


def path_conditions(steps: DataFrame, guards: DataFrame) -> DataFrame:
    """Conditions met on a path: one row per branch taken.

    ``steps(path, seq, unit, src, label)`` are the edges a path takes. The if-edge adds
    the condition, the else-edge its negation, a jump or a branch whose two targets are
    equal adds nothing. ``guards(unit, src, var, cmp, const, same_target)``.
    """
    met = steps.where(F.col("label").isin("if", "else")).join(guards.where("NOT same_target"), ["unit", "src"])
    return met.select(
        "path", "seq", "var", F.when(F.col("label") == "if", F.col("cmp")).otherwise(negate_condition(F.col("cmp"))).alias("cmp"), "const"
    )


def else_conditions(guards: DataFrame) -> DataFrame:
    """Both edges of each guard: the condition on ``if``, its complement on ``else``."""
    sides = F.array(
        F.struct(F.lit("if").alias("label"), F.col("cmp").alias("_cmp")),
        F.struct(F.lit("else").alias("label"), negate_condition(F.col("cmp")).alias("_cmp")),
    )
    others = [c for c in guards.columns if c != "cmp"]
    return guards.select(*others, F.inline(sides)).withColumnRenamed("_cmp", "cmp")


def switch_conditions(switches: DataFrame) -> DataFrame:
    """``cond = case`` per case target; ``default`` adds no condition, so it has no row.

    ``switches`` has ``cases``, a map of case text -> target block.
    """
    others = [c for c in switches.columns if c not in ("cases", "var")]
    entries = switches.select(*others, "var", F.explode(F.map_entries("cases")).alias("_e")).where("_e.key <> 'default'")
    return entries.select(
        *others, "var", F.col("_e.value").alias("dst"), F.lit("=").alias("cmp"), F.col("_e.key").alias("const")
    )


def feasible_paths(conditions: DataFrame, path: list[str], integers: bool = False) -> DataFrame:
    """Is the conjunction of ``var cmp const`` on each path satisfiable?

    Bounds and excluded constants are reduced per (path, variable); all of it is
    partial aggregation. An unknown comparator or constant leaves the path reachable
    and marks it imprecise; a null comparator is no condition, and ``true`` always holds. ``integers`` solves over whole numbers, else over reals.
    """
    known = F.col("cmp").isin("=", "!=", "<", "<=", ">", ">=") & F.col("const").isNotNull()
    shift = 1 if integers else 0
    lower = F.when(F.col("cmp").isin("=", ">="), F.col("const")).when(F.col("cmp") == ">", F.col("const") + shift)
    upper = F.when(F.col("cmp").isin("=", "<="), F.col("const")).when(F.col("cmp") == "<", F.col("const") - shift)
    asks = F.col("cmp").isNotNull() & (F.col("cmp") != "true")
    typed = conditions.withColumn("_known", known).withColumn("_open", asks & ~F.coalesce(known, F.lit(False)))
    bounds = typed.groupBy(*path, "var").agg(
        F.max(F.when(F.col("_known"), lower)).alias("lo"),
        F.min(F.when(F.col("_known"), upper)).alias("hi"),
        F.max(F.when(F.col("cmp") == ">", F.col("const"))).alias("above"),
        F.min(F.when(F.col("cmp") == "<", F.col("const"))).alias("below"),
        F.bool_or("_open").alias("open"),
        F.max(F.when(F.col("cmp") == "!=", 1).otherwise(0)).alias("_has_ne"),
    )
    excluded = (
        typed.where("_known AND cmp = '!='")
        .join(bounds.where("_has_ne = 1 AND lo <= hi").select(*path, "var", "lo", "hi"), [*path, "var"])
        .where("const BETWEEN lo AND hi")
        .groupBy(*path, "var")
        .agg(F.count_distinct("const").alias("holes"))
    )
    judged = bounds.join(excluded, [*path, "var"], "left").withColumn("holes", F.coalesce("holes", F.lit(0)))
    room = F.col("hi") - F.col("lo") + 1 if integers else F.lit(1)
    pinned = F.lit(True) if integers else F.col("lo") == F.col("hi")
    strict = F.lit(False) if integers else (F.col("lo") == F.col("hi")) & (
        (F.col("above") == F.col("lo")) | (F.col("below") == F.col("hi"))
    )
    empty = (F.col("lo") > F.col("hi")) | (pinned & (F.col("holes") >= room)) | strict
    return judged.groupBy(*path).agg(
        (~F.bool_or(F.coalesce(empty, F.lit(False)))).alias("reachable"),
        F.bool_or("open").alias("imprecise"),
    ).withColumn("reachable", F.col("reachable") | F.col("imprecise"))


def mark_imprecise(steps: DataFrame, path: list[str]) -> DataFrame:
    """``imprecise`` inherited along the path from the first step that has it."""
    flagged = steps.withColumn("_flag", F.col("undecided").cast("int"))
    marked = running_max(flagged, path, ["seq"], "_flag", "_seen")
    return marked.withColumn("imprecise", F.coalesce(F.col("_seen") == 1, F.lit(False))).drop("_flag", "_seen")


def definitely_assigned(reads: DataFrame, untrusted: Column) -> DataFrame:
    """``isset`` of each read: false when never assigned, null (unknown) otherwise."""
    assigned = F.col("def_seq").isNotNull() | untrusted
    return reads.withColumn("isset", F.when(~assigned, F.lit(False)))


def symbolic_expression(ops: DataFrame) -> DataFrame:
    """Expression text of each op's value along its chain of definitions.

    ``ops(unit, seq, def_seq, operator, right, leaf, entry)``: an operator wraps its
    definition's text, none copies it; ``leaf`` (non-null) starts a text, ``entry`` is
    the text of a variable that was not written before. The wrapping is kept as a text
    before and a text after, which combine associatively: long chains take log rounds.
    """
    opening = F.when(F.col("operator").isNotNull(), F.lit("((")).otherwise(F.lit(""))
    before = F.when(F.col("def_seq").isNull(), F.concat(opening, F.col("entry"))).otherwise(opening)
    after = F.when(
        F.col("operator").isNotNull(),
        F.concat(F.lit(") "), symbol_of(F.col("operator")), F.lit(" ("), F.col("right"), F.lit("))")),
    ).otherwise(F.lit(""))
    nodes = ops.select(
        "unit",
        "seq",
        F.when(F.col("leaf").isNull(), F.col("def_seq")).alias("parent"),
        F.when(F.col("leaf").isNull(), before).otherwise(F.col("leaf")).alias("before"),
        F.when(F.col("leaf").isNull(), after).otherwise(F.lit("")).alias("after"),
    )
    done = follow_pointers(
        nodes,
        ["unit", "seq"],
        "parent",
        {
            "before": lambda mine, theirs: F.concat(mine, F.coalesce(theirs, F.lit(""))),
            "after": lambda mine, theirs: F.concat(F.coalesce(theirs, F.lit("")), mine),
        },
    )
    return done.select("unit", "seq", F.concat("before", "after").alias("expr"))


def symbol_letters(number: Column) -> Column:
    """1 -> a, 26 -> z, 27 -> aa, and so on."""
    start = F.struct(number.cast("bigint").alias("rest"), F.lit("").alias("text"))
    spelled = F.aggregate(
        F.sequence(F.lit(1), F.lit(14)),
        start,
        lambda acc, _: F.when(
            acc["rest"] > 0,
            F.struct(
                F.floor((acc["rest"] - 1) / 26).cast("bigint").alias("rest"),
                F.concat(F.char((acc["rest"] - 1) % 26 + 97), acc["text"]).alias("text"),
            ),
        ).otherwise(acc),
    )
    return spelled["text"]


def number_symbols(accesses: DataFrame, name: str, unit: str = "unit") -> DataFrame:
    """Variables of a unit numbered in the order they are first seen, with their letters."""
    coarse = [F.min(c).alias(c) for c in with_slice(accesses)]
    first = accesses.groupBy(unit, name).agg(F.min("seq").alias("first_seen"), *coarse)
    numbered = row_sequence(first, [unit], ["first_seen", name], "number")
    return numbered.withColumn("symbol", symbol_letters(F.col("number")))


def prune_unreachable(edges: DataFrame, feasible: DataFrame) -> DataFrame:
    """Edges between feasible blocks; taint and the rest then run on these only."""
    ok = feasible.select("unit", "block")
    return edges.join(ok.withColumnRenamed("block", "src"), ["unit", "src"], "left_semi").join(
        ok.withColumnRenamed("block", "dst"), ["unit", "dst"], "left_semi"
    )
