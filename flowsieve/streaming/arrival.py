"""Analysis of programs as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.session import cut, new_folder

#: Folders that the kept rows are dealt to by the hash of their unit; a batch lists at most so many.
BUCKETS = 512


def _rows(out: str) -> str:
    return f"{out.rstrip('/')}-rows"


def _units(out: str) -> str:
    return f"{out.rstrip('/')}-units"


def _bucket(unit: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(unit), F.lit(buckets)).cast("int")


def analyse_arrivals(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    analysis: Callable[[DataFrame], DataFrame],
    out: str,
    *,
    glob: str = "*.parquet",
    files_per_batch: int | None = None,
    state: str | None = None,
    unit: str | None = None,
    buckets: int = BUCKETS,
    progress: list[dict] | None = None,
) -> None:
    """Run ``analysis`` on each batch of new files and keep its rows below ``out``.

    A batch is written to a folder of its own number, so a batch that is repeated
    after a failure replaces its rows. ``state`` is the folder that remembers which
    files were done; with the same one a later call takes only what is new.

    ``unit`` names the column whose rows belong together. With it the rows of every batch
    are also kept beside ``out``, dealt to ``buckets`` folders by the unit, and ``analysis`` gets all rows so far of the
    units that the batch touches: only the folders of these units are read, so the work of a batch follows
    what it touches and not the history. ``latest_arrivals`` reads what holds for each unit since its last batch.
    The number of buckets is fixed with the first batch. To ``progress`` a dict per batch is added: its number, the
    kept rows that were read for it, and those of its units.
    """
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def keep(batch: DataFrame, number: int) -> None:
        if unit is not None:
            dealt = batch.withColumn("_bucket", _bucket(unit, buckets))
            # a folder gets one file of a batch, or a few if it is large, not one of every task
            dealt.hint("rebalance", "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{_rows(out)}/_batch={number}")
            kept = spark.read.schema(dealt.withColumn("_batch", F.lit(0)).schema).parquet(_rows(out))
            own = kept.where(F.col("_batch") == number).select(F.col(unit).alias("_unit"), F.col("_bucket").alias("_of")).distinct()
            own.select("_unit").write.mode("overwrite").parquet(f"{_units(out)}/_batch={number}")
            # at most as many numbers as there are buckets; they are folders, so the others are not opened
            touched = [r["_of"] for r in own.select("_of").distinct().collect()]
            known = kept.where(F.col("_bucket").isin(touched) & (F.col("_batch") <= number))
            read, held = Observation(), Observation()
            known = known.observe(read, F.count(F.lit(1)).alias("rows")).drop("_batch", "_bucket")
            mine = known.join(own, F.col(unit).eqNullSafe(F.col("_unit")), "left_semi")
            batch = cut(mine.observe(held, F.count(F.lit(1)).alias("rows")))
            if progress is not None:
                progress.append({"batch": number, "read": read.get["rows"] if touched else 0, "held": held.get["rows"]})
        analysis(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (
        reader.parquet(folder)
        .writeStream.foreachBatch(keep)
        .option("checkpointLocation", state or new_folder(spark, "arrivals"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def latest_arrivals(spark: SparkSession, out: str, key: str) -> DataFrame:
    """The rows below ``out`` that hold now: each unit's from the last batch that touched it.

    ``key`` is the column of the analysis' rows that holds the ``unit`` of the events. Only the
    units of each batch are read for it, not their rows.
    """
    last = spark.read.parquet(_units(out)).groupBy("_unit").agg(F.max("_batch").alias("_last"))
    found = spark.read.parquet(out)
    now = F.col(key).eqNullSafe(F.col("_unit")) & (F.col("batch") == F.col("_last"))
    return found.join(last, now, "left_semi").drop("batch")
