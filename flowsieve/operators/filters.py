"""Filters and inventories over instructions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.operands import operand_key

# Instruction type -> kind of declaration.
DECLARATIONS = {
    "Stmt_Trait": "trait",
    "Stmt_Class": "class",
    "Stmt_Interface": "interface",
    "Stmt_ClassMethod": "method",
    "Stmt_Function": "function",
    "Terminal_Const": "constant",
}

# Instruction type -> kind of call.
CALL_KINDS = {
    "Expr_FuncCall": "function",
    "Expr_NsFuncCall": "namespaced",
    "Expr_MethodCall": "method",
    "Expr_StaticCall": "static",
    "Expr_New": "new",
}


def _kind(kinds: dict[str, str]):
    pairs = [F.lit(x) for pair in kinds.items() for x in pair]
    return F.create_map(*pairs)[F.col("op")]


def truncate_at_exit(ops: DataFrame, block: list[str]) -> DataFrame:
    """Drop the ops of a block from its first ``exit`` on."""
    stops = ops.where("operation = 'exit'").groupBy(*block).agg(F.min("seq").alias("_stop"))
    return ops.join(stops, block, "left").where("_stop IS NULL OR seq < _stop").drop("_stop")


def declarations(ops: DataFrame) -> DataFrame:
    """Declaring ops with their kind, one row each."""
    return ops.withColumn("kind", _kind(DECLARATIONS)).where("kind IS NOT NULL")


def declaration_inventory(ops: DataFrame) -> DataFrame:
    """Declared names by kind: how often, and where first."""
    return declarations(ops).groupBy("kind", "name").agg(
        F.count(F.lit(1)).alias("declared"), F.min(F.struct("unit", "seq")).alias("first")
    )


def call_inventory(ops: DataFrame) -> DataFrame:
    """Calls by kind, calling unit and callee."""
    return (
        ops.withColumn("kind", _kind(CALL_KINDS))
        .where("kind IS NOT NULL")
        .groupBy("kind", F.col("unit").alias("caller"), "callee")
        .agg(F.count(F.lit(1)).alias("calls"))
    )


def variable_inventory(operands: DataFrame, unit: list[str]) -> DataFrame:
    """Distinct operands of each unit, merge operands included."""
    return operands.select(*unit, operand_key(F.col("var")).alias("_k")).select(*unit, "_k.*").distinct()


def located_ops(ops: DataFrame) -> DataFrame:
    """Ops with a known line, as a number."""
    return ops.withColumn("line", F.col("start_line").try_cast("int")).where("line IS NOT NULL")


def eval_concat_list(parts: DataFrame, keys: list[str], separator: str = "") -> DataFrame:
    """Texts of one instruction's operands joined in order; the group is one operand list."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return parts.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda p: p["text"]), separator).alias("text"))
