"""Type facts from tested conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.operators.fixpoint import follow_pointers
from flowsieve.session import cut


def guard_facts(guards: DataFrame) -> DataFrame:
    """A type fact on the if-edge and its negation on the else-edge."""
    sides = F.array(
        F.struct(F.lit("if").alias("label"), F.col("negated").alias("_neg")),
        F.struct(F.lit("else").alias("label"), (~F.col("negated")).alias("_neg")),
    )
    others = [c for c in guards.columns if c != "negated"]
    return guards.select(*others, F.inline(sides)).withColumnRenamed("_neg", "negated")


def combine_guards(terms: DataFrame, keys: list[str]) -> DataFrame:
    """Terms of one condition merged per variable.

    ``terms`` has keys, pos, mode (``or`` unites, ``and`` intersects), tested_type and
    negated. Gives the ordered distinct terms (at most two per type, so bounded) and
    the types a value can have when the condition holds, of the un-negated terms; null
    where it can have any: ``or`` with a negated term.
    """
    distinct = terms.groupBy(*keys, "mode", "tested_type", "negated").agg(F.min("pos").alias("pos"))
    merged = distinct.groupBy(*keys, "mode").agg(
        F.array_sort(F.collect_list(F.struct("pos", "tested_type", "negated"))).alias("_t"),
        F.array_sort(F.collect_set(F.when(~F.col("negated"), F.col("tested_type")))).alias("_types"),
    )
    several = F.size("_types") > 1
    return merged.select(
        *keys,
        "mode",
        F.transform("_t", lambda t: F.struct(t["tested_type"], t["negated"])).alias("terms"),
        # a value has one type: an intersection of different types is empty
        F.when((F.col("mode") == "or") & F.exists("_t", lambda t: t["negated"]), F.lit(None).cast("array<string>"))
        .when((F.col("mode") == "and") & several, F.array().cast("array<string>"))
        .otherwise(F.col("_types"))
        .alias("types"),
    )


def render_guard(terms: Column, mode: Column, negated: Column) -> Column:
    """``type(..)`` or ``not(..)`` terms joined by ``|`` or ``&``, in brackets when several."""
    sign = F.when(mode == "or", F.lit("|")).otherwise(F.lit("&"))
    each = F.transform(
        terms,
        lambda t: F.when(
            t["negated"], F.concat(F.lit("not(type(LITERAL('"), t["tested_type"], F.lit("')))"))
        ).otherwise(F.concat(F.lit("type(LITERAL('"), t["tested_type"], F.lit("'))"))),
    )
    joined = F.concat_ws("", F.element_at(each, 1), F.array_join(F.transform(F.slice(each, F.lit(2), F.size(each)), lambda t: F.concat(sign, t)), ""))
    text = F.when(F.size(terms) > 1, F.concat(F.lit("("), joined, F.lit(")"))).otherwise(joined)
    return F.when(negated, F.concat(F.lit("not("), text, F.lit(")"))).otherwise(text)


def _joined(so_far: Column, part: Column) -> Column:
    """Two parts about one variable, by the ``mode`` of the row; ``others`` turns types into all but these."""
    either = F.col("mode") == "or"
    a, b, x, y = so_far["types"], part["types"], so_far["others"], part["others"]
    # ``and`` is ``or`` of the complements, so both are the same with the flags turned
    p, q = x == either, y == either
    types = F.when(p & q, F.array_intersect(a, b)).when(p, F.array_except(a, b)).when(q, F.array_except(b, a))
    sign = F.when(either, F.lit("|")).otherwise(F.lit("&"))
    return F.struct(
        F.concat(F.lit("("), so_far["text"], sign, part["text"], F.lit(")")).alias("text"),
        types.otherwise(F.array_union(a, b)).alias("types"),
        F.when(either, x | y).otherwise(x & y).alias("others"),
    )


def guard_trees(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """What nested conditions say about the types of their variables: keys, var, text, types, others.

    ``nodes`` has keys, node, parent (null at the root), pos (order below the parent), mode (``or`` / ``and`` of an inner
    node), var and tested_type (of a test; null: a test of something else) and negated. ``text`` joins two parts about
    the same variable in brackets, part by part, and wraps a negated one in ``not``; a part that says nothing
    about a variable leaves the other as it is. ``types`` are the types that the text lets a value have or, where
    ``others`` is true, all but these: negation is pushed down to the tests. Trees are contracted from the deepest level up, all
    trees at once; of each node only its own parts meet.
    """
    depths = follow_pointers(
        nodes.select(*keys, "node", "parent", F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth")),
        [*keys, "node"], "parent", {"depth": lambda mine, theirs: mine + theirs},
    )
    placed = cut(nodes.join(depths.select(*keys, "node", "depth"), [*keys, "node"]))
    deepest = placed.agg(F.max("depth")).first()[0]
    none = F.array().cast("array<string>")
    leaf = placed.where("tested_type IS NOT NULL AND var IS NOT NULL").select(
        *keys, "node", "depth", "var", F.concat(F.lit("type(LITERAL('"), "tested_type", F.lit("'))")).alias("text"),
        F.array("tested_type").alias("types"), F.lit(False).alias("others"),
    )
    facts = None
    for depth in range(deepest if deepest is not None else 0, -1, -1):
        here = placed.where(F.col("depth") == depth)
        made = leaf.where(F.col("depth") == depth).drop("depth")
        if facts is not None:
            parts = facts.join(placed.select(*keys, "node", "parent", "pos"), [*keys, "node"])
            merged = parts.groupBy(*keys, F.col("parent").alias("node"), "var").agg(
                F.array_sort(F.collect_list(F.struct("pos", "text", "types", "others"))).alias("_parts")
            )
            merged = merged.join(here.select(*keys, "node", "mode"), [*keys, "node"])
            start = F.struct(F.get("_parts", 0)["text"].alias("text"), F.get("_parts", 0)["types"].alias("types"), F.get("_parts", 0)["others"].alias("others"))
            whole = F.aggregate(F.slice("_parts", F.lit(2), F.size("_parts")), start, _joined)
            made = made.unionByName(merged.select(*keys, "node", "var", whole.alias("_w")).select(*keys, "node", "var", "_w.*"))
        signs = here.select(*keys, "node", F.coalesce("negated", F.lit(False)).alias("_not"))
        facts = cut(
            made.join(signs, [*keys, "node"]).select(
                *keys, "node", "var",
                F.when(F.col("_not"), F.concat(F.lit("not("), "text", F.lit(")"))).otherwise(F.col("text")).alias("text"),
                F.array_sort("types").alias("types"), (F.col("others") != F.col("_not")).alias("others"),
            )
        )
    return facts.drop("node") if facts is not None else leaf.drop("node", "depth")
