"""Merging of taint states, and the aggregations over findings and operands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.operators.ordered import row_sequence


def state_union(left: Column, right: Column) -> Column:
    return F.array_sort(F.array_union(left, right))


def state_intersect(left: Column, right: Column) -> Column:
    return F.array_sort(F.array_intersect(left, right))


def merge_union(states: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: tainted if any is, sanitizers united.

    The names are spread into rows, so partial aggregation leaves at most one row per
    key and name before the shuffle, whatever the number of states.
    """
    spread = states.select(*keys, "tainted", F.explode_outer("sanitizers").alias("_name"))
    return spread.groupBy(*keys).agg(
        F.bool_or("tainted").alias("tainted"),
        F.array_sort(F.collect_set("_name")).alias("sanitizers"),
    )


def merge_intersect(states: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: tainted if any is, sanitizers present in every state.

    Counted per (key, name) first; the row with a null name counts the states.
    """
    spread = states.select(
        *keys,
        "tainted",
        F.explode(F.array_append(F.array_distinct("sanitizers"), F.lit(None))).alias("_name"),
    )
    counted = spread.groupBy(*keys, "_name").agg(F.bool_or("tainted").alias("tainted"), F.count(F.lit(1)).alias("_n"))
    merged = counted.groupBy(*keys).agg(
        F.bool_or("tainted").alias("tainted"),
        F.max(F.when(F.col("_name").isNull(), F.col("_n"))).alias("_states"),
        F.collect_list(F.when(F.col("_name").isNotNull(), F.struct("_name", "_n"))).alias("_names"),
    )
    shared = F.filter("_names", lambda s: s["_n"] == F.col("_states"))
    return merged.select(
        *keys, "tainted", F.array_sort(F.transform(shared, lambda s: s["_name"])).alias("sanitizers")
    )


def propagate_through_native(arguments: DataFrame, policy: DataFrame, keys: list[str]) -> DataFrame:
    """``array_push``-like calls: taint of the watched arguments goes to the listed ones.

    ``arguments`` has ``keys``, callee, pos, var and tainted. Of a propagator row the
    category holds the watched positions (0 for any), positions the receiving ones.
    """
    rules = policy.where("kind = 'propagator'").select(
        F.col("name").alias("callee"),
        F.transform(F.split("category", ","), lambda p: p.cast("int")).alias("_from"),
        F.col("positions").alias("_to"),
    )
    matched = arguments.join(rules, "callee")
    watched = (F.element_at("_from", 1) == 0) | F.array_contains("_from", F.col("pos"))
    any_taint = matched.groupBy(*keys).agg(F.bool_or(F.col("tainted") & watched).alias("tainted"))
    receivers = matched.where(F.array_contains("_to", F.col("pos"))).select(*keys, "pos", "var")
    return receivers.join(any_taint, keys)


def findings_summary(findings: DataFrame) -> DataFrame:
    """Number of findings by category, with a total row whose category is null."""
    return findings.rollup("category").agg(F.count(F.lit(1)).alias("findings"))


def dedupe_findings(findings: DataFrame, by: list[str], others: list[str]) -> DataFrame:
    """One finding per ``by``: the first category in policy order, then the first instruction."""
    first = F.min_by(F.struct(*others), F.struct("seq", "category_rank"))
    return findings.groupBy(*by).agg(first.alias("_f")).select(*by, "_f.*")


def coverage_stats(visits: DataFrame) -> DataFrame:
    """Distinct known lines per stage and module."""
    return visits.groupBy("stage", "module").agg(
        F.count_distinct("file", F.expr("try_cast(start_line AS INT)")).alias("lines")
    )


def visit_counts(visits: DataFrame) -> DataFrame:
    """Entries per block; a second entry means the block is part of a loop."""
    return (
        visits.groupBy("unit", "block")
        .agg(F.count(F.lit(1)).alias("visits"))
        .withColumn("looping", F.col("visits") > 1)
    )


def variable_usage(accesses: DataFrame, keys: list[str]) -> DataFrame:
    """Per variable how many ops write and read it, and the first and last of each.

    Counts and bounds aggregate partially; the ops themselves are the rows of ``variable_accesses``.
    """
    return accesses.groupBy(*keys).agg(
        *[
            f(F.when(F.col("role") == role, F.col("seq"))).alias(f"{role}_{name}")
            for role in ("write", "read")
            for name, f in (("count", F.count), ("first", F.min), ("last", F.max))
        ]
    )


def variable_accesses(accesses: DataFrame, keys: list[str]) -> DataFrame:
    """The accesses themselves as an ordered table: ``number`` counts a variable's reads, and its writes, by ``seq``.

    A variable that a third of all rows name is numbered slice by slice (``row_sequence``), never in one list.
    """
    return row_sequence(accesses, [*keys, "role"], ["seq"], "number")
