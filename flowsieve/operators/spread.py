"""Facts carried along the edges of many graphs at once.

Facts of a unit are followed inside the task that has its edges (``inside``); the facts of a block that differ only in
what they are about (a variable) are bits of a word there. A unit with very many edges is several parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.operators.inside import deal_large_units, follow
from flowsieve.session import cut

#: Bits of a word; a long has 63 that are not the sign.
WORD = 62

def _links(edges: DataFrame, backward: bool = False) -> DataFrame:
    start, to = ("dst", "src") if backward else ("src", "dst")
    return cut(edges.select("unit", F.col(start).alias("block"), F.col(to).alias("_to")).distinct())


def spread(facts: DataFrame, edges: DataFrame, extra: list[str], *, backward: bool = False, bits: int = WORD) -> DataFrame:
    """``facts(unit, block, *extra)`` plus the same facts at every block they reach.

    Forward a fact goes from ``src`` to ``dst``, backward the other way.
    """
    links = _links(edges, backward)
    return follow(facts.select("unit", "block", *extra), links, extra, deal=deal_large_units(links), bits=bits)


def flood(facts: DataFrame, edges: DataFrame, stops: DataFrame, extra: list[str], *, bits: int = WORD) -> DataFrame:
    """``facts(unit, block, *extra)`` carried along edges, but never into a block of ``stops``.

    ``stops`` has the same columns: what holds a fact back differs by ``extra``. A fact
    that starts at a stop is still carried on from there.
    """
    links = _links(edges)
    return follow(facts.select("unit", "block", *extra), links, extra, stops=stops, deal=deal_large_units(links), bits=bits)


def breadth_first(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """Blocks reached from ``entries(unit, block)`` with the number of steps as ``level``."""
    links = _links(edges)
    start = entries.select("unit", "block", F.lit(0).cast("bigint").alias("level"))
    found = follow(start, links, [], "level", least=True, deal=deal_large_units(links))
    return found.withColumn("level", F.col("level").cast("int"))
