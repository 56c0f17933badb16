"""Ordered operators that survive a group holding a third of all rows.

A window over (key, order) puts a whole key into one task. Large inputs therefore
carry a column ``slice``: a coarse order, the same for all keys, cut at quantiles
so that a slice holds a bounded number of rows. Windows then run per (key, slice)
and a small per-slice summary carries the state from one slice to the next.
Without the column the plain window is used.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.session import cut, cut_counted

SLICE = "slice"
SLICE_ROWS = 4_000_000


def rows_per_slice(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("flowsieve.rows.per.slice", str(SLICE_ROWS)))


def order_number(name: str, dtype: str) -> Column:
    """A number that never falls when the column rises (seconds for times)."""
    if dtype.startswith("timestamp"):
        return F.expr(
            f"(date_diff(to_date({name}), DATE'1970-01-01') * 86400D + hour({name}) * 3600D"
            f" + minute({name}) * 60D + second({name}))"
        )
    return F.col(name).cast("double")


def add_slices(df: DataFrame, order: str) -> DataFrame:
    """Add ``slice`` when the table is larger than one slice; else return it as it is."""
    wanted = -(-df.count() // rows_per_slice(df))
    if wanted <= 1:
        return df
    number = order_number(order, dict(df.dtypes)[order])
    shares = [i / wanted for i in range(1, wanted)]
    # wanted - 1 numbers reach the driver
    bounds = df.select(F.percentile_approx(number, shares, 10 * wanted).alias("b")).first()["b"]
    splits = [float("-inf"), *sorted(set(bounds)), float("inf")]
    cutter = Bucketizer(splits=splits, inputCol="_order", outputCol="_slice")
    return (
        cutter.transform(df.withColumn("_order", number))
        .withColumn(SLICE, F.col("_slice").cast("int"))
        .drop("_order", "_slice")
    )


def add_range_slices(df: DataFrame, order: list[str]) -> DataFrame:
    """As ``add_slices`` for an order of several columns of any type, such as names.

    The range partitions are written, so a row keeps its slice when tasks are repeated.
    """
    table, rows = cut_counted(df)
    wanted = -(-rows // rows_per_slice(df))
    if wanted <= 1:
        return table
    return cut(table.repartitionByRange(wanted, *order).withColumn(SLICE, F.spark_partition_id()))


def with_slice(df: DataFrame) -> list[str]:
    return [SLICE] if SLICE in df.columns else []


def _carry(df: DataFrame, keys: list[str], agg: Column, over: str) -> DataFrame:
    """One row per (key, slice) with the aggregate over all earlier slices of the key."""
    per_slice = df.groupBy(*keys, SLICE).agg(agg.alias("_part"))
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    return per_slice.select(*keys, SLICE, F.expr(f"{over}(_part)").over(earlier).alias("_carry"))


def _attach(df: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    same.append(F.col(f"l.{SLICE}").eqNullSafe(F.col(f"r.{SLICE}")))
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    extra = [c for c in summary.columns if c not in keys + [SLICE]]
    return df.alias("l").join(summary.alias("r"), cond, "left").select("l.*", *[f"r.{c}" for c in extra])


def row_sequence(df: DataFrame, keys: list[str], order: list, name: str = "seq") -> DataFrame:
    """1-based position of each row within its key."""
    inner = Window.partitionBy(*keys, *with_slice(df)).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(inner))
    if not with_slice(df):
        return out
    before = _carry(df, keys, F.count(F.lit(1)), "sum")
    return (
        _attach(out, before, keys)
        .withColumn(name, (F.col(name) + F.coalesce("_carry", F.lit(0))).cast("int"))
        .drop("_carry")
    )


def running_max(df: DataFrame, keys: list[str], order: list, value: str, name: str) -> DataFrame:
    """Largest non-null ``value`` among the rows before this one, this one included."""
    inner = (
        Window.partitionBy(*keys, *with_slice(df)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    out = df.withColumn(name, F.max(value).over(inner))
    if not with_slice(df):
        return out
    return (
        _attach(out, _carry(df, keys, F.max(value), "max"), keys)
        .withColumn(name, F.greatest(name, "_carry"))
        .drop("_carry")
    )


def next_value(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``value`` of the following row of the key, null at its end."""
    inner = Window.partitionBy(*keys, *with_slice(df)).orderBy(*order)
    out = df.withColumn(name, F.lead(value).over(inner))
    if not with_slice(df):
        return out
    firsts = df.groupBy(*keys, SLICE).agg(F.min_by(value, F.struct(*order)).alias("_first"))
    following = firsts.select(
        *keys, SLICE, F.lead("_first").over(Window.partitionBy(*keys).orderBy(SLICE)).alias("_next")
    )
    # only the last row of a (key, slice) has no follower inside it
    return (
        _attach(out, following, keys).withColumn(name, F.coalesce(name, "_next")).drop("_next")
    )
