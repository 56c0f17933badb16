"""Named stage lists: each stage works on the output of the one before."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from flowsieve.operators.states import coverage_stats
from flowsieve.session import cut

PROFILE_SCHEMA = "MAP<STRING, ARRAY<STRUCT<traversal: STRING, modules: ARRAY<ARRAY<STRING>>>>>"

Stage = Callable[[DataFrame], DataFrame]


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """``(name, stage, traversal, modules)`` of a profile file."""
    return parse_profiles(spark.read.text(path, wholetext=True).withColumnRenamed("value", "text"))


def parse_profiles(texts: DataFrame) -> DataFrame:
    named = texts.select(F.explode(F.from_json("text", PROFILE_SCHEMA)).alias("name", "_stages"))
    return named.select("name", F.posexplode("_stages").alias("stage", "_s")).select("name", "stage", "_s.*")


def run_profile(
    facts: DataFrame, profiles: DataFrame, name: str, modules: dict[str, Stage], measures: list[tuple] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Result of the last stage, and the distinct lines each stage and module saw.

    ``modules`` maps the module name of the file to any DataFrame -> DataFrame function. To ``measures`` a row
    (stage, module, rows, known lines, seconds) is added for each module: rows that it gave and those of them with
    a known line, observed while they are written, and the time it took.
    """
    plan = profiles.where(F.col("name") == name).orderBy("stage").collect()
    if not plan:
        raise KeyError(name)
    current, seen = facts, []
    for row in plan:
        for module in row["modules"]:
            start, watch = time.perf_counter(), Observation()
            known = F.count_if(F.expr("try_cast(start_line AS INT)").isNotNull()).alias("known")
            made = current.transform(modules[module[0]])
            current = cut(made.observe(watch, F.count(F.lit(1)).alias("rows"), known))
            if measures is not None:
                got = watch.get
                measures.append((row["stage"], module[-1], got["rows"], got["known"], time.perf_counter() - start))
            seen.append(
                current.select(
                    F.lit(row["stage"]).alias("stage"), F.lit(module[-1]).alias("module"), "file", "start_line"
                )
            )
    return current, coverage_stats(reduce(DataFrame.unionByName, seen))


def measure_table(spark: SparkSession, measures: list[tuple]) -> DataFrame:
    """``measures`` of ``run_profile`` as a table, a row per module."""
    return spark.createDataFrame(measures, "stage int, module string, rows bigint, known_lines bigint, seconds double")
