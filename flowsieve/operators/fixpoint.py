"""Loops that grow a set of facts until nothing new appears.

Only the new facts of a round (the delta) are joined with the edges. Each round is
written to the shared folder, so the plan stays short. A delta below Spark's
broadcast threshold is broadcast by its true size and the edges stay where they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from flowsieve.session import cut, cut_counted

# parts of the known set are merged into one table when there are this many
PARTS = 6
# steps of a round; each costs a join of the new facts, a round costs the writing and comparing as well
HOPS = 2


def _without(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` whose keys are not in ``known``; null equals null, so a null key comes to rest too."""
    return rows.join(_named(known, keys), _equal(keys), "left_anti")


def _named(known: DataFrame, keys: list[str]) -> DataFrame:
    return known.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in known.columns if c not in keys])


def _equal(keys: list[str]) -> Column:
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    cond = same[0]
    for other in same[1:]:
        cond = cond & other
    return cond


def grow(
    seeds: DataFrame,
    step: Callable[[DataFrame], DataFrame],
    keys: list[str],
    *,
    levels: bool = False,
    within: list[str] | None = None,
    hops: int = HOPS,
) -> DataFrame:
    """Least set that holds ``seeds`` and is closed under ``step``.

    ``within`` names key columns that ``step`` never changes: only the known facts of
    groups with new facts are compared, so that the rest of the known set is read but
    not shuffled again. Null keys are keys like any other.

    With ``levels`` a fact has the number of steps after which it first appears as
    ``level``. Facts that are known already never enter the next round, so a round
    costs what is new in it; a round takes ``hops`` steps at once. The loop ends when a
    round brings nothing new, however many that takes.
    """
    first = seeds.select(*keys).distinct()
    delta, _ = cut_counted(first.withColumn("level", F.lit(0)) if levels else first)
    parts = [delta]
    level = 0
    while True:
        front, fronts = delta, []
        for hop in range(1, hops + 1):
            front = step(front).select(*keys).distinct()
            fronts.append(front.withColumn("level", F.lit(level + hop)) if levels else front)
        reached = _union(fronts)
        if levels:
            reached = reached.groupBy(*keys).agg(F.min("level").alias("level"))
        elif hops > 1:
            reached = reached.distinct()
        known = _union(parts).select(*keys)
        if within:
            known = known.join(_named(delta.select(*within).distinct(), within), _equal(within), "left_semi")
        delta, new_rows = cut_counted(_without(reached, known, keys))
        if new_rows == 0:
            return _union(parts)
        parts.append(delta)
        level += hops
        # what lies between has been followed already; only the outermost facts are new ground
        if levels and hops > 1:
            delta = delta.where(F.col("level") == level)
        if len(parts) > PARTS:
            parts = [cut(_union(parts))]


def _gained(reached: DataFrame, old: DataFrame, keys: list[str], mask: str) -> DataFrame:
    """Rows of ``reached`` that are new or have bits (``_new``) that the old row (``_old``) hasn't."""
    return (
        reached.join(_named(old, keys), _equal(keys), "left")
        .where("_old IS NULL OR (_new | _old) <> _old")
        .select(*keys, F.expr("_new | coalesce(_old, 0L)").alias(mask))
    )


def grow_masks(
    seeds: DataFrame,
    step: Callable[[DataFrame], DataFrame],
    keys: list[str],
    mask: str,
    *,
    within: list[str] | None = None,
    hops: int = HOPS,
    known: DataFrame | None = None,
) -> DataFrame:
    """Fixpoint where a fact carries a bit set that only gains bits.

    A row enters the next round when it is new or when it has gained bits. ``within`` names key columns that
    ``step`` never changes: only the groups with news are compared. A round takes ``hops`` steps at once.
    ``known`` is the result of an earlier call that the seeds are new to; it is part of the result.
    """
    merged = F.bit_or(mask).alias(mask)
    first = seeds.groupBy(*keys).agg(merged)
    parts: list[DataFrame] = []
    if known is not None:
        parts.append(known.select(*keys, mask))
        first = _gained(first.withColumnRenamed(mask, "_new"), parts[0].withColumnRenamed(mask, "_old"), keys, mask)
    delta, rows = cut_counted(first)
    if not rows:
        return known if known is not None else delta
    parts.append(delta)
    while True:
        front, fronts = delta, []
        for _ in range(hops):
            front = step(front).groupBy(*keys).agg(merged)
            fronts.append(front)
        reached = _union(fronts).groupBy(*keys).agg(F.bit_or(mask).alias("_new"))
        known = _union(parts)
        if within:
            known = known.join(_named(delta.select(*within).distinct(), within), _equal(within), "left_semi")
        old = known.groupBy(*keys).agg(F.bit_or(mask).alias("_old"))
        delta, new_rows = cut_counted(_gained(reached, old, keys, mask))
        if new_rows == 0:
            return _union(parts).groupBy(*keys).agg(merged)
        parts.append(delta)
        if len(parts) > PARTS:
            parts = [cut(_union(parts).groupBy(*keys).agg(merged))]


def follow_pointers(
    nodes: DataFrame,
    keys: list[str],
    pointer: str,
    carry: dict[str, Callable[[Column, Column], Column]],
) -> DataFrame:
    """Combine the ``carry`` columns along single parent pointers, in log rounds.

    The last of ``keys`` is what ``pointer`` refers to; every pointer names a row. A row
    whose pointer is null is settled; each round an open row takes over its target's
    pointer and combines with it by ``combine(own, target)``, which must be associative,
    so the distance looked ahead doubles. Rows on a circle end with a pointer left.
    Once few rows are open they are broadcast, and the settled ones are only read.
    """
    scope, own = keys[:-1], keys[-1]
    is_open = F.col(pointer).isNotNull()
    current, open_rows = cut_counted(nodes.select(*keys, pointer, *carry), is_open)
    settled: list[DataFrame] = []
    while open_rows:
        settled.append(current.where(~is_open))
        target = _union([*settled, current.where(is_open)]).select(
            *[F.col(k).alias(f"_{k}") for k in scope],
            F.col(own).alias("_own"),
            F.col(pointer).alias("_pointer"),
            *[F.col(c).alias(f"_{c}") for c in carry],
        )
        cond = F.col(pointer) == F.col("_own")
        for k in scope:
            cond = cond & (F.col(k) == F.col(f"_{k}"))
        seen = Observation()
        moved = (
            current.where(is_open)
            .join(target, cond)
            .select(
                *keys,
                F.col("_pointer").alias(pointer),
                *[combine(F.col(c), F.col(f"_{c}")).alias(c) for c, combine in carry.items()],
            )
            .observe(seen, F.count(F.lit(1)).alias("moved"))
        )
        expected = open_rows
        current, open_rows = cut_counted(moved, is_open)
        if seen.get["moved"] != expected:
            raise ValueError(f"{expected - seen.get['moved']} pointers name no row, or a key is not unique")
        # a chain of any length has rows that settle in every round, so only circles are left
        if open_rows == expected:
            break
    return _union([*settled, current])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
