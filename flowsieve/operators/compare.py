"""Comparison of two versions of a graph or of a result with its expectation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.text import canonicalise_text


def diff_graphs(old: DataFrame, new: DataFrame, keys: list[str], values: list[str], both_ways: bool = True) -> DataFrame:
    """Rows that differ: ``changed``, ``missing`` (only old) or ``new`` (only new).

    Compared null-safe. ``both_ways=False`` leaves out what only the new side has.
    """
    left = old.select(*keys, F.struct(*values).alias("_old"))
    right = new.select(*keys, F.struct(*values).alias("_new"))
    status = (
        F.when(F.col("_new").isNull(), "missing")
        .when(F.col("_old").isNull(), "new")
        .when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    )
    joined = left.join(right, keys, "full_outer" if both_ways else "left")
    return joined.withColumn("status", status).where("status IS NOT NULL").select(*keys, "status")


def compare_golden(actual: DataFrame, expected: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Keys whose canonical texts differ, or that one side lacks."""
    left = actual.select(*keys, canonicalise_text(F.col(text)).alias("_actual"))
    right = expected.select(*keys, canonicalise_text(F.col(text)).alias("_expected"))
    status = (
        F.when(F.col("_expected").isNull(), "unexpected")
        .when(F.col("_actual").isNull(), "absent")
        .when(F.col("_actual") != F.col("_expected"), "different")
    )
    return left.join(right, keys, "full_outer").select(*keys, status.alias("status")).where("status IS NOT NULL")


def order_cases(cases: Column) -> Column:
    """Switch cases by numeric id, those without one last by their text."""

    def before(a: Column, b: Column) -> Column:
        left, right = a["id"].try_cast("int"), b["id"].try_cast("int")
        steps = [
            (left.isNull() & right.isNotNull(), 1),
            (left.isNotNull() & right.isNull(), -1),
            (left < right, -1),
            (left > right, 1),
            (a["key"] < b["key"], -1),
            (a["key"] > b["key"], 1),
        ]
        return reduce(lambda acc, s: F.when(s[0], F.lit(s[1])).otherwise(acc), reversed(steps), F.lit(0))

    return F.array_sort(cases, before)
