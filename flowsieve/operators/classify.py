"""Joins of instructions and operands with the policy.

The policy is a small table whose size Spark knows, so these joins are broadcast by
Spark's own size check and do not shuffle the instructions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.expressions import guard_type


def _names(policy: DataFrame, kind: str) -> DataFrame:
    return policy.where(F.col("kind") == kind).select(F.col("name").alias("_name")).distinct()


def tested_name() -> Column:
    """What a sanitizer list is asked for: the op of a cast, else the callee."""
    return F.when(F.col("op").startswith("Expr_Cast_"), F.col("op")).otherwise(F.col("callee"))


def sink_name() -> Column:
    """What a sink list is asked for: the callee of a call, else the operation."""
    return F.coalesce("callee", "operation")


def classify_source_vars(operands: DataFrame, policy: DataFrame, name: str = "name") -> DataFrame:
    """Operands whose variable is an untrusted input."""
    listed = _names(policy, "source_variable")
    return operands.join(listed, F.col(name) == F.col("_name"), "left_semi")


def classify_source_calls(ops: DataFrame, policy: DataFrame) -> DataFrame:
    """Calls that return untrusted data."""
    return ops.join(_names(policy, "source_call"), F.col("callee") == F.col("_name"), "left_semi")


def classify_full_sanitizers(ops: DataFrame, policy: DataFrame) -> DataFrame:
    """Calls and casts that clean a value for every category."""
    return ops.join(_names(policy, "full_sanitizer"), tested_name() == F.col("_name"), "left_semi")


def classify_conditional_sanitizers(ops: DataFrame, policy: DataFrame) -> DataFrame:
    """Calls that clean for some categories; ``sanitizers`` holds their name."""
    listed = _names(policy, "conditional_sanitizer")
    return ops.join(listed, F.col("callee") == F.col("_name")).withColumn("sanitizers", F.array("_name")).drop("_name")


def classify_sinks(ops: DataFrame, policy: DataFrame) -> DataFrame:
    """One row per instruction and sink category it belongs to."""
    sinks = policy.where("kind = 'sink'").select(
        F.col("name").alias("_name"), "category", F.col("rank").alias("category_rank"), "positions", "safe_by"
    )
    return ops.join(sinks, sink_name() == F.col("_name")).drop("_name")


def match_sink_arguments(sinks: DataFrame, arguments: DataFrame, keys: list[str]) -> DataFrame:
    """Arguments a sink watches: any for position 0, else the listed 1-based ones."""
    watched = (F.element_at("positions", 1) == 0) | F.array_contains("positions", F.col("pos"))
    return sinks.join(arguments, keys).where(watched)


def sanitizer_mismatch(matched: DataFrame, applied: str = "sanitizers") -> DataFrame:
    """Tainted arguments that met no sanitizer the sink accepts; a null set is the empty set, a null flag untainted."""
    none = F.array().cast("array<string>")
    met = F.arrays_overlap(F.coalesce(applied, none), F.coalesce("safe_by", none))
    return matched.where(F.coalesce("tainted", F.lit(False)) & ~F.coalesce(met, F.lit(False)))


def guard_types(calls: DataFrame) -> DataFrame:
    """Calls of type predicates with the tested type."""
    return calls.withColumn("tested_type", guard_type(F.col("callee"))).where("tested_type IS NOT NULL")


def flag_ops(ops: DataFrame, policy: DataFrame, read_name: str = "read_name") -> DataFrame:
    """Add ``is_source``, ``is_full`` and ``conditional`` (name or null) in one pass."""

    def listed(kind: str, mark: str) -> DataFrame:
        return _names(policy, kind).select(F.col("_name").alias(mark))

    return (
        ops.join(listed("source_call", "_sc"), F.col("callee") == F.col("_sc"), "left")
        .join(listed("source_variable", "_sv"), F.col(read_name) == F.col("_sv"), "left")
        .join(listed("full_sanitizer", "_fs"), tested_name() == F.col("_fs"), "left")
        .join(listed("conditional_sanitizer", "conditional"), F.col("callee") == F.col("conditional"), "left")
        .withColumn("is_source", F.col("_sc").isNotNull() | F.col("_sv").isNotNull())
        .withColumn("is_full", F.col("_fs").isNotNull())
        .drop("_sc", "_sv", "_fs")
    )
