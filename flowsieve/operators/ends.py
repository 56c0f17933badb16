"""Chains of pointers and merges with one operand, resolved inside the task that has the rows of their unit.

A unit with more rows than a task may have (``flowsieve.rows.per.group``) is resolved by joins, in rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.operators.fixpoint import follow_pointers
from flowsieve.operators.inside import Inside, _codes, _codes_of, group_rows
from flowsieve.session import cut, cut_counted, ship

MERGE, RENAME = range(2)


def split_by_size(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``rows(unit, ...)`` of units that fit a task, and those of the others if there are any."""
    sized = rows.groupBy("unit").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > group_rows(rows))
    large, count = cut_counted(sized.select(F.col("unit").alias("_large")))
    if not count:
        return rows, None
    same = F.col("unit").eqNullSafe(F.col("_large"))
    return rows.join(large, same, "left_anti"), rows.join(large, same, "left_semi")


def dealt(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_part", F.lit(0)).repartition("unit").sortWithinPartitions("unit")


def follow_ends(nodes: DataFrame, keys: list[str], pointer: str, carry: list[str]) -> DataFrame:
    """``nodes`` with the ``carry`` columns of the row in which their chain of pointers ends.

    As in ``follow_pointers`` the first of ``keys`` is the unit, the last one what ``pointer`` refers to, and every pointer names a row.
    Where a chain ends the pointer is null; rows that lead into a circle keep theirs, and what they carry means nothing.
    """
    ship(nodes.sparkSession)
    nodes = cut(nodes.select(*keys, pointer, *carry))
    small, large = split_by_size(nodes.withColumnRenamed(keys[0], "unit"))
    shape = T.StructType([T.StructField(f.name, f.dataType) for f in small.schema.fields])
    ends = dealt(small).mapInArrow(Ends(["unit", *keys[1:]], pointer, carry), shape)
    if large is not None:
        last = {f"_{c}": lambda mine, theirs: F.coalesce(theirs, mine) for c in carry}
        marked = large.select("unit", *keys[1:], pointer, *[F.when(F.col(pointer).isNull(), F.struct(c)).alias(f"_{c}") for c in carry])
        done = follow_pointers(marked, ["unit", *keys[1:]], pointer, last)
        ends = ends.unionByName(done.select("unit", *keys[1:], pointer, *[F.col(f"_{c}")[c].alias(c) for c in carry]))
    return ends.withColumnRenamed("unit", keys[0])


def lasts(to: np.ndarray) -> np.ndarray:
    """Where the pointers of rows lead in the end; a row that points to itself is an end."""
    for _ in range(len(to).bit_length() + 1):
        further = to[to]
        if np.array_equal(further, to):
            break
        to = further
    return to


class Ends(Inside):
    def __init__(self, keys: list[str], pointer: str, carry: list[str]):
        self.keys, self.pointer, self.carry = keys, pointer, carry

    def followed(self, table: pa.Table) -> Iterator[pa.RecordBatch]:
        scope = np.zeros(table.num_rows, np.int64)
        for name in self.keys[:-1]:
            code, values, _ = _codes(table[name])
            scope = scope * len(values) + code
        (own, target), values, _ = _codes_of([table[self.keys[-1]], table[self.pointer]])
        own, target = scope * len(values) + own, scope * len(values) + target
        rows = np.flatnonzero(np.asarray(table[self.pointer].is_valid()))
        order = np.argsort(own, kind="stable")
        low, high = (np.searchsorted(own[order], target[rows], side) for side in ("left", "right"))
        if (high - low != 1).any():
            raise ValueError(f"{int((high - low != 1).sum())} pointers name no row, or a key is not unique")
        to = np.arange(table.num_rows)
        to[rows] = order[low]
        to = lasts(to)
        open_end = np.zeros(table.num_rows, bool)
        open_end[rows] = True
        left = table[self.pointer].combine_chunks().to_pylist() if open_end[to].any() else None
        pointer = pa.nulls(table.num_rows, table[self.pointer].type) if left is None else pa.array([p if o else None for p, o in zip(left, open_end[to])], table[self.pointer].type)
        columns = [*[table[k] for k in self.keys], pointer, *[table[c].take(pa.array(to)) for c in self.carry]]
        yield from pa.table(columns, names=[*self.keys, self.pointer, *self.carry]).to_batches(max_chunksize=50_000)


class Trivial(Inside):
    """Merges ``(unit, result, operand)`` without those that have one operand, and what stands for these."""

    def __init__(self):
        pass

    def followed(self, table: pa.Table) -> Iterator[pa.RecordBatch]:
        unit, _, _ = _codes(table["unit"])
        (result, operand), names, _ = _codes_of([table["result"], table["operand"]])
        many = len(names)
        first = np.zeros(unit.max() + 1, np.int64)
        first[unit[::-1]] = np.arange(len(unit))[::-1]
        # a merge or operand is a number in its unit; the merges of all units shrink together
        pairs = np.unique(np.stack([unit * many + result, unit * many + operand], axis=1), axis=0)
        gone, targets = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while len(pairs):
            merge, start, count = np.unique(pairs[:, 0], return_index=True, return_counts=True)
            single = count == 1
            if not single.any():
                break
            name, stands = merge[single], pairs[start[single], 1]
            place = np.minimum(np.searchsorted(name, stands), len(name) - 1)
            again = name[place] == stands
            to = lasts(np.where(again, place, np.arange(len(name))))
            target = np.where(again[to], -1, stands[to])
            targets = np.concatenate([self.renamed(targets, name, target), target])
            gone = np.concatenate([gone, name])
            pairs = pairs[~np.isin(pairs[:, 0], name)]
            pairs = np.stack([pairs[:, 0], self.renamed(pairs[:, 1], name, target)], axis=1)
            pairs = np.unique(pairs[(pairs[:, 1] >= 0) & (pairs[:, 0] != pairs[:, 1])], axis=0)
        left = np.concatenate([pairs[:, 0], gone])
        right = np.concatenate([pairs[:, 1], targets])
        kinds = np.repeat(np.array([MERGE, RENAME], np.int8), [len(pairs), len(gone)])
        to = names.take(pa.array(right % many, pa.int64(), mask=right < 0))
        columns = [table["unit"].take(pa.array(first[left // many])), pa.array(kinds), names.take(pa.array(left % many)), to]
        yield from pa.table(columns, names=["unit", "_kind", "result", "operand"]).to_batches(max_chunksize=50_000)

    @staticmethod
    def renamed(numbers: np.ndarray, name: np.ndarray, target: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(name, numbers), len(name) - 1)
        return np.where(name[place] == numbers, target[place], numbers)


class Heights(Inside):
    """Operands ``(unit, seq, pos, origin, ...)`` with ``height``, that of their expression, and ``below``, that of what they name.

    Rows without ``pos`` are leaves, of height 0, as are operands without ``origin``. Operands of expressions without a height (something
    that they are made of is no row, or they are made of themselves) are left out, and so are the leaves.
    """

    def __init__(self):
        pass

    def followed(self, table: pa.Table) -> Iterator[pa.RecordBatch]:
        unit, _, _ = _codes(table["unit"])
        (own, target), values, _ = _codes_of([table["seq"], table["origin"]])
        nodes, own = np.unique(unit * len(values) + own, return_inverse=True)
        key = unit * len(values) + target
        target = np.minimum(np.searchsorted(nodes, key), len(nodes) - 1)
        named, operand = (np.asarray(table[c].is_valid()) for c in ("origin", "pos"))
        lost = named & (nodes[target] != key)
        height = np.full(len(nodes), -1, np.int64)
        height[own[~operand]] = 0
        open_rows = np.flatnonzero(operand)
        while len(open_rows):
            below = np.where(named[open_rows], height[target[open_rows]], 0)
            late = (below < 0) | lost[open_rows]
            waits = np.zeros(len(nodes), bool)
            waits[own[open_rows[late]]] = True
            ready = ~waits[own[open_rows]]
            if not ready.any():
                break
            np.maximum.at(height, own[open_rows[ready]], below[ready] + 1)
            open_rows = open_rows[~ready]
        kept = np.flatnonzero(operand & (height[own] > 0))
        below = np.where(named, height[target], 0)[kept]
        table = table.take(pa.array(kept)).drop_columns(["_part"])
        table = table.append_column("height", pa.array(height[own[kept]], pa.int32())).append_column("below", pa.array(below, pa.int32()))
        yield from table.to_batches(max_chunksize=50_000)


def with_heights(operands: DataFrame) -> DataFrame:
    """``operands(unit, seq, pos, origin, ...)`` as in ``Heights``, those of large units by joins, a height at a time."""
    ship(operands.sparkSession)
    small, large = split_by_size(operands)
    shape = T.StructType([*small.schema.fields, T.StructField("height", T.IntegerType()), T.StructField("below", T.IntegerType())])
    found = dealt(small).mapInArrow(Heights(), shape)
    if large is None:
        return cut(found)
    large = cut(large)
    known = cut(large.where("pos IS NULL").select("unit", F.col("seq").alias("origin"), F.lit(0).alias("below")).distinct())
    waiting, rows = cut_counted(large.where("pos IS NOT NULL"))
    parts = [found]
    while rows:
        met = waiting.join(known, ["unit", "origin"], "left").withColumn("below", F.when(F.col("origin").isNull(), 0).otherwise(F.col("below")))
        top = met.groupBy("unit", "seq").agg((F.max("below") + 1).alias("height"), F.bool_or(F.col("below").isNull()).alias("_late")).where("NOT _late")
        fresh, more = cut_counted(met.join(top.drop("_late"), ["unit", "seq"]).select(*large.columns, "height", "below"))
        if not more:
            break
        parts.append(fresh)
        known = cut(known.unionByName(fresh.select("unit", F.col("seq").alias("origin"), F.col("height").alias("below")).distinct()))
        waiting, rows = cut_counted(waiting.join(fresh.select("unit", "seq").distinct(), ["unit", "seq"], "left_anti"))
    for part in parts[1:]:
        found = found.unionByName(part)
    return cut(found)
