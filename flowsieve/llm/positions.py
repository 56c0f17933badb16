"""Positions of rows in a total order, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.session import cut


def with_position(df: DataFrame, order: Column, name: str) -> DataFrame:
    """``df`` with its row number from 0 in the given order.

    Rows are range-partitioned and numbered inside their partition; only the sizes of the
    partitions, one row each, are summed up in order.
    """
    spread = df.repartitionByRange(order).sortWithinPartitions(order)
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = cut(spread.withColumn("__part", F.spark_partition_id()).withColumn("__inside", inside))
    sizes = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return rows.join(sizes, "__part").withColumn(name, F.col("__before") + F.col("__inside")).select(*df.columns, name)
