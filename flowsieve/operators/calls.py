"""Taint across calls, each return matched with its own call.

What a unit does to a value is summed up once, whoever calls it: a row per *root* (a parameter, or
``GENERATED`` for a source inside) and per value that the root reaches, with the mask of sanitizers that
some way avoids. At a call, a summary from parameter to return becomes a flow of the caller, from the argument to
the call's output. Summaries grow from the units without calls up; units that call each other
gain from one another until nothing is new. Only then do the actual arguments run down. So a value
that one caller hands in comes out at that caller alone.

Tables: ``flows(unit, var, to_var, clears)`` inside units (``clears``: sanitizers applied, 0 for none),
``arguments(unit, call, var, callee, param)``, ``outputs(unit, call, callee, var)``, ``returns(unit, var)``,
``sources(unit, var)``, ``params(unit, var)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.operators.fixpoint import grow_masks
from flowsieve.operators.taint import ALL_OPEN
from flowsieve.session import cut, cut_counted, sizes_in_memory

#: Root of what a unit's own sources taint; parameters are roots by their name.
GENERATED = "!"
PATH = ["unit", "root", "var"]


def _root(param: str):
    return F.concat(F.lit("="), F.col(param).cast("string"))


def unit_paths(
    flows: DataFrame, arguments: DataFrame, outputs: DataFrame, returns: DataFrame, sources: DataFrame, params: DataFrame
) -> DataFrame:
    """(unit, root, var, open_mask): what each parameter and the sources of a unit reach in it, calls included."""
    with sizes_in_memory(flows.sparkSession):
        return _unit_paths(flows, arguments, outputs, returns, sources, params)


def _unit_paths(
    flows: DataFrame, arguments: DataFrame, outputs: DataFrame, returns: DataFrame, sources: DataFrame, params: DataFrame
) -> DataFrame:
    """Every round follows the flows inside all units, then turns the summaries that are new into flows
    at the calls of their units; only those and what they reach enter the next round. Rounds go as deep as
    calls are nested, and further round recursive calls as long as masks gain.
    """
    flows = cut(flows.select("unit", "var", "to_var", "clears"))
    given = arguments.select("unit", "call", "var", "callee", _root("param").alias("root"))
    calls = cut(
        outputs.select("unit", "call", "callee", F.col("var").alias("to_var")).join(given, ["unit", "call", "callee"])
    )
    called = cut(outputs.select("unit", "callee", F.col("var").alias("to_var")).distinct())
    returned = cut(returns.select("unit", "var").distinct())

    def inside(delta: DataFrame, links: DataFrame) -> DataFrame:
        return delta.join(links, ["unit", "var"]).select(
            "unit", "root", F.col("to_var").alias("var"), F.expr("open_mask & ~clears").alias("open_mask")
        )

    full = F.lit(ALL_OPEN).cast("bigint").alias("open_mask")
    seeds = params.select("unit", _root("var").alias("root"), "var", full).unionByName(
        sources.select("unit", F.lit(GENERATED).alias("root"), "var", full)
    )
    links, paths, summaries = flows, None, None
    while True:
        at_hand = links
        paths = cut(grow_masks(seeds, lambda delta: inside(delta, at_hand), PATH, "open_mask", within=["unit"], known=paths))
        # of all ways through a unit the callers need only what comes out
        now = paths.join(returned, ["unit", "var"], "left_semi").groupBy("unit", "root").agg(F.bit_or("open_mask").alias("open_mask"))
        if summaries is not None:
            before = summaries.select("unit", "root", F.col("open_mask").alias("_old"))
            fresh, news = cut_counted(now.join(before, ["unit", "root"], "left").where("_old IS NULL OR open_mask <> _old").drop("_old"))
        else:
            fresh, news = cut_counted(now)
        if not news:
            return paths
        summaries = cut(now)
        callee = fresh.withColumnRenamed("unit", "callee")
        through = calls.join(callee, ["callee", "root"]).select("unit", "var", "to_var", F.expr("~open_mask").alias("clears"))
        through = cut(through.groupBy("unit", "var", "to_var").agg(F.bit_and("clears").alias("clears")))
        links = cut(
            links.unionByName(through).groupBy("unit", "var", "to_var").agg(F.bit_and("clears").alias("clears"))
        )
        generated = callee.where(F.col("root") == GENERATED).select("callee", "open_mask")
        seeds = inside(paths, through).unionByName(
            called.join(generated, "callee").select("unit", F.lit(GENERATED).alias("root"), F.col("to_var").alias("var"), "open_mask")
        )
        seeds = cut(seeds.groupBy(*PATH).agg(F.bit_or("open_mask").alias("open_mask")))


def tainted_parameters(paths: DataFrame, arguments: DataFrame) -> DataFrame:
    """(unit, var, open_mask): parameters that some call hands taint to, from the callers down."""
    given = arguments.select("unit", "var", "callee", "param")
    reach = cut(
        paths.join(given, ["unit", "var"])
        .groupBy("unit", "root", "callee", "param")
        .agg(F.bit_or("open_mask").alias("_through"))
    )
    start = reach.where(F.col("root") == GENERATED).select(F.col("callee").alias("unit"), F.col("param").alias("var"), F.col("_through").alias("open_mask"))
    onward = cut(reach.where(F.col("root") != GENERATED))

    def step(delta: DataFrame) -> DataFrame:
        asked = delta.withColumn("root", _root("var")).drop("var")
        return asked.join(onward, ["unit", "root"]).select(
            F.col("callee").alias("unit"), F.col("param").alias("var"), F.expr("open_mask & _through").alias("open_mask")
        )

    return grow_masks(start, step, ["unit", "var"], "open_mask")


def matched_taint(
    flows: DataFrame, arguments: DataFrame, outputs: DataFrame, returns: DataFrame, sources: DataFrame, params: DataFrame
) -> DataFrame:
    """(unit, var, open_mask) of every value that is tainted in some run, calls matched with their returns.

    Parameters are tainted only by the calls that are made; a parameter nobody fills is clean.
    Calls without a declared callee have no rows in ``arguments`` and ``outputs``; what native calls do is
    part of ``flows`` (``native_flows``). An include is a call whose parameters are the variables that the included
    unit asks for (``include_arguments``).
    """
    with sizes_in_memory(flows.sparkSession):
        return cut(_matched_taint(cut(unit_paths(flows, arguments, outputs, returns, sources, params)), arguments))


def _matched_taint(paths: DataFrame, arguments: DataFrame) -> DataFrame:
    given = cut(tainted_parameters(paths, arguments))
    handed = paths.where(F.col("root") != GENERATED).join(
        given.select("unit", _root("var").alias("root"), F.col("open_mask").alias("_mask")), ["unit", "root"]
    )
    every = paths.where(F.col("root") == GENERATED).select("unit", "var", "open_mask").unionByName(
        handed.select("unit", "var", F.expr("open_mask & _mask").alias("open_mask"))
    )
    return every.groupBy("unit", "var").agg(F.bit_or("open_mask").alias("open_mask"))


def native_flows(arguments: DataFrame, policy: DataFrame, keys: list[str]) -> DataFrame:
    """Flows of ``array_push``-like calls, from each watched argument to each receiving one.

    ``arguments`` has ``keys`` (unit first), callee, pos and var; the rules are the propagators of the policy.
    """
    rules = policy.where("kind = 'propagator'").select(
        F.col("name").alias("callee"),
        F.transform(F.split("category", ","), lambda p: p.cast("int")).alias("_from"),
        F.col("positions").alias("_to"),
    )
    matched = arguments.join(rules, "callee")
    watched = (F.element_at("_from", 1) == 0) | F.array_contains("_from", F.col("pos"))
    given = matched.where(watched).select(*keys, "var").distinct()
    taken = matched.where(F.array_contains("_to", F.col("pos"))).select(*keys, F.col("var").alias("to_var")).distinct()
    return given.join(taken, keys).where("var <> to_var").select(
        keys[0], "var", "to_var", F.lit(0).cast("bigint").alias("clears")
    ).distinct()


def include_arguments(sites: DataFrame, asked: DataFrame, visible: DataFrame) -> DataFrame:
    """Rows for ``arguments``: an include hands on the variables that the included unit asks for.

    ``sites(unit, call, callee)``, ``asked(callee, name, param)`` the names that a unit reads before it writes them,
    ``visible(unit, call, name, var)`` the value that a name has at the site.
    """
    wanted = sites.select("unit", "call", "callee").join(asked, "callee")
    return wanted.join(visible, ["unit", "call", "name"]).select("unit", "call", "var", "callee", "param")
