"""Links between instructions, operands, calls and blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.operators.ordered import running_max, with_slice


def def_use_edges(writes: DataFrame, reads: DataFrame, keys: list[str]) -> DataFrame:
    """Writer -> reader rows over operands in SSA form, equal ``keys`` on both sides.

    In that form a variable has one writer, so there is one row per read.
    """
    left = writes.select(*keys, F.col("seq").alias("def_seq"))
    right = reads.select(*keys, F.col("seq").alias("use_seq"))
    return left.join(right, keys)


def link_accesses(accesses: DataFrame, keys: list[str]) -> DataFrame:
    """As-of link over one list of reads (``is_write`` 0) and writes (1).

    Gives the reads with ``def_seq``, the latest earlier write of their variable. The
    last write is carried along the ordered list, so no read meets more than its own
    answer and nothing is joined back: further columns of a read just stay with it. A
    read at the same ``seq`` as a write comes first.
    """
    marked = accesses.withColumn("_def", F.when(F.col("is_write") == 1, F.col("seq")))
    linked = running_max(marked, keys, ["seq", "is_write"], "_def", "def_seq")
    return linked.where("is_write = 0").drop("is_write", "_def")


def reaching_definition(reads: DataFrame, writes: DataFrame, keys: list[str]) -> DataFrame:
    """``link_accesses`` over reads and writes that come as two tables."""
    cols = [*keys, *with_slice(writes), "seq"]
    both = reads.withColumn("is_write", F.lit(0)).unionByName(
        writes.select(*cols, F.lit(1).alias("is_write")), allowMissingColumns=True
    )
    return link_accesses(both, keys)


def resolve_calls(calls: DataFrame, units: DataFrame, callee: str = "callee") -> DataFrame:
    """Add ``is_user``: the callee is a declared unit; else the call is native."""
    known = units.select(F.col("unit").alias("_declared")).distinct()
    return (
        calls.join(known, F.col(callee) == F.col("_declared"), "left")
        .withColumn("is_user", F.col("_declared").isNotNull())
        .drop("_declared")
    )


def bind_arguments(arguments: DataFrame, params: DataFrame) -> DataFrame:
    """Argument i of a call -> parameter i of its callee; surplus arguments drop out."""
    formal = params.select(F.col("unit").alias("callee"), "pos", F.col("var").alias("param"))
    return arguments.join(formal, ["callee", "pos"])


def bind_returns(calls: DataFrame, returns: DataFrame) -> DataFrame:
    """State of a call's output: any return tainted, sanitizers united; no return -> untainted.

    ``returns(unit, tainted, sanitizers)`` is merged per callee before the join.
    """
    merged = merge_returns(returns).withColumnRenamed("unit", "callee")
    return (
        calls.join(merged, "callee", "left")
        .withColumn("tainted", F.coalesce("tainted", F.lit(False)))
        .withColumn("sanitizers", F.coalesce("sanitizers", F.array().cast("array<string>")))
    )


def merge_returns(returns: DataFrame) -> DataFrame:
    from flowsieve.operators.states import merge_union

    return merge_union(returns, ["unit"])


def merge_operand_by_predecessor(operands: DataFrame, parents: DataFrame, entries: DataFrame) -> DataFrame:
    """Operand of each merge for the predecessor taken: the one of its number, or the last one.

    ``operands(unit, block, var, number, operand)`` and ``parents(unit, block, number, parent)`` are numbered from 1;
    ``entries(unit, block, came_from)``. A predecessor that is listed twice has its first number; one that is
    not listed has no row. Everything is joined by numbers, so a block with many parents is many rows.
    """
    taken = parents.groupBy("unit", "block", F.col("parent").alias("came_from")).agg(F.min("number").alias("_number"))
    last = operands.groupBy("unit", "block", "var").agg(F.max("number").alias("_last"))
    wanted = entries.join(taken, ["unit", "block", "came_from"]).join(last, ["unit", "block"])
    wanted = wanted.withColumn("number", F.least("_number", "_last")).drop("_number", "_last")
    return wanted.join(operands, ["unit", "block", "var", "number"]).drop("number")


def predecessors(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """Distinct parent rows of each emitted block; parents that were not emitted drop out."""
    emitted = blocks.select("unit", F.col("block").alias("src"))
    return (
        edges.select("unit", F.col("dst").alias("block"), "src")
        .distinct()
        .join(emitted, ["unit", "src"], "left_semi")
    )


def link_includes(includes: DataFrame, units: DataFrame, path: str = "path") -> DataFrame:
    """Literal include -> unit ``main_<basename>``, null when there is none."""
    wanted = F.concat(F.lit("main_"), F.substring_index(path, "/", -1))
    known = units.select(F.col("unit").alias("target")).distinct()
    return includes.join(known, wanted == F.col("target"), "left")


def control_edges(ops: DataFrame) -> DataFrame:
    """Edges of jumps, conditional jumps, switches and bodies.

    ``ops`` has unit, block, target, if_target, else_target, body, body_label and
    cases (array of label/dst structs), each null where it does not apply.
    """
    single = F.array(
        F.struct(F.lit("target").alias("label"), F.col("target").alias("dst")),
        F.struct(F.lit("if").alias("label"), F.col("if_target").alias("dst")),
        F.struct(F.lit("else").alias("label"), F.col("else_target").alias("dst")),
        F.struct(F.col("body_label").alias("label"), F.col("body").alias("dst")),
    )
    every = F.concat(single, F.coalesce("cases", F.array().cast("array<struct<label:string,dst:int>>")))
    return ops.select("unit", F.col("block").alias("src"), F.inline(every)).where("dst IS NOT NULL")
