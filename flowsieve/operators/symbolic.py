"""Symbolic values as a shared table of expressions, with any number of operands.

An expression is a row (id, operator, operands), its operands being ids; equal expressions are one row, wherever
they occur, so a value that is used twice does not double anything. Texts are made on request.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.expressions import symbol_of
from flowsieve.operators.ends import follow_ends, with_heights
from flowsieve.session import cut, cut_counted

#: Parts of the known operands that are kept before those of done levels are dropped.
PARTS = 6


@dataclass
class Expressions:
    """``values(unit, seq, id)`` and ``nodes(id, level, operator, leaf, operands)``."""

    values: DataFrame
    nodes: DataFrame


def symbolic_values(ops: DataFrame) -> Expressions:
    """Number the values of all instructions.

    ``ops(unit, seq, operator, leaf, operands)`` with ``operands`` an array of structs (def_seq, leaf): a
    definition, or the text of a constant or unwritten variable. A row with a ``leaf`` is such a text itself; one
    without operator hands on its only operand. Copies are followed and heights found inside the task that
    has the unit; then expressions are numbered level by level, each distinct one once. An operand is joined in the level after that of
    what it names, and grouped in the level of its expression, so each is shuffled once. Every ``def_seq`` names a row.
    """
    ops = cut(ops.select("unit", "seq", "operator", "leaf", "operands"))
    first = F.get("operands", 0)
    copies = F.col("leaf").isNull() & F.col("operator").isNull()
    pointers = ops.select(
        "unit", "seq",
        F.when(copies, first["def_seq"]).alias("next"),
        F.when(~copies | first["def_seq"].isNull(), F.col("seq")).alias("origin"),
    )
    ends = follow_ends(pointers, ["unit", "seq"], "next", ["origin"])
    ends = cut(ends.select("unit", "seq", "origin"))
    kinds = ops.join(ends.where("seq = origin").select("unit", "seq"), ["unit", "seq"], "left_semi").select(
        "unit", "seq", "operator", F.coalesce("leaf", F.when(copies, first["leaf"])).alias("leaf"), "operands"
    )
    kinds = cut(kinds)
    asked = kinds.where("leaf IS NULL").select("unit", "seq", "operator", F.posexplode("operands").alias("pos", "_o")).select(
        "unit", "seq", "pos", "operator", F.col("_o.def_seq").alias("child"), F.col("_o.leaf").alias("text")
    )
    target = ends.select("unit", F.col("seq").alias("child"), "origin")
    waiting = asked.join(target, ["unit", "child"], "left").select("unit", "seq", "pos", "operator", "text", "origin")
    leaves = kinds.where("leaf IS NOT NULL").select("unit", "seq")
    waiting = with_heights(cut(waiting.unionByName(leaves, allowMissingColumns=True)))

    # level 0: texts, those of operands as well
    texts = kinds.where("leaf IS NOT NULL").select("leaf").unionByName(waiting.where("origin IS NULL").select(F.col("text").alias("leaf")))
    number = F.monotonically_increasing_id()
    none = F.lit(None).cast("array<bigint>")
    level, rows = cut_counted(texts.distinct().select(number.alias("id"), F.lit(0).alias("level"), F.lit(None).cast("string").alias("operator"), "leaf", none.alias("operands")))
    nodes, base = [level], 0
    found = cut(kinds.where("leaf IS NOT NULL").join(level.select("leaf", "id"), "leaf").select("unit", "seq", "id"))
    values = [found]
    part = ["unit", "seq", "pos", "operator", "height", "id"]
    direct = waiting.where("origin IS NULL").join(level.select(F.col("leaf").alias("text"), "id"), "text").select(*part)
    known = [cut(direct)]
    top = waiting.agg(F.max("height")).first()[0] or 0
    for depth in range(1, top + 1):
        links = waiting.where((F.col("below") == depth - 1) & F.col("origin").isNotNull())
        known.append(cut(links.join(found.select("unit", F.col("seq").alias("origin"), "id"), ["unit", "origin"]).select(*part)))
        if len(known) > PARTS:
            known = [cut(_all(known).where(F.col("height") >= depth))]
        here = _all(known).where(F.col("height") == depth).groupBy("unit", "seq").agg(
            F.first("operator").alias("operator"), F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("_o")
        )
        ready = cut(here.select("unit", "seq", "operator", F.transform("_o", lambda o: o["id"]).alias("operands")))
        base = level.agg(F.max("id")).first()[0] + 1 if rows else base
        distinct = ready.groupBy("operator", "operands").agg(F.lit(0).alias("_"))
        level, rows = cut_counted(
            distinct.select((number + F.lit(base)).alias("id"), F.lit(depth).alias("level"), "operator", F.lit(None).cast("string").alias("leaf"), "operands")
        )
        nodes.append(level)
        found = cut(ready.join(level.select("operator", "operands", "id"), ["operator", "operands"]).select("unit", "seq", "id"))
        values.append(found)
    table, every = _all(nodes), _all(values)
    shown = ends.join(every.withColumnRenamed("seq", "origin"), ["unit", "origin"]).select("unit", "seq", "id")
    return Expressions(cut(shown), cut(table))


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def expression_texts(found: Expressions, wanted: DataFrame, longest: int | None = None) -> DataFrame:
    """(id, expr) of the ``wanted(id)`` expressions: ``((left) sign (right))``, as deep as they go.

    Each shared part is written once. A text doubles with every level that uses a value twice; beyond
    ``longest`` characters a text is null.
    """
    nodes = cut(found.nodes.withColumn("sign", symbol_of(F.col("operator"))))
    need = cut(wanted.select("id").distinct())
    used, new = need, 1
    while new:
        parts = nodes.join(need, "id", "left_semi").select(F.explode("operands").alias("id")).distinct()
        need, new = cut_counted(parts.join(used, "id", "left_anti"))
        used = cut(used.unionByName(need)) if new else used
    nodes = cut(nodes.join(used, "id", "left_semi"))
    top = nodes.agg(F.max("level")).first()[0]
    texts = cut(nodes.where("level = 0").select("id", F.col("leaf").alias("expr")))
    for level in range(1, (top or 0) + 1):
        asked = nodes.where(F.col("level") == level).select("id", "sign", F.posexplode("operands").alias("pos", "child"))
        filled = asked.join(texts.select(F.col("id").alias("child"), F.concat(F.lit("("), "expr", F.lit(")")).alias("part")), "child")
        # a null part makes the whole null: nothing is left out unseen
        joined = filled.groupBy("id", "sign").agg(
            F.array_sort(F.collect_list(F.struct("pos", "part"))).alias("_p"), F.bool_or(F.col("part").isNull()).alias("_lost")
        )
        parts = F.transform("_p", lambda p: p["part"])
        text = F.concat(F.lit("("), F.call_function("array_join", parts, F.concat(F.lit(" "), F.col("sign"), F.lit(" "))), F.lit(")"))
        text = F.when(~F.col("_lost"), text)
        if longest is not None:
            text = F.when(F.length(text) <= longest, text)
        texts = cut(texts.unionByName(joined.select("id", text.alias("expr"))))
    return texts.join(wanted.select("id").distinct(), "id", "left_semi")
