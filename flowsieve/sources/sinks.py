"""Writers: findings as a partitioned table, graphs as DOT lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_findings(findings: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Findings below one folder per category."""
    findings.write.partitionBy("category").format(fmt).save(path)


def _quoted(*parts: str | Column) -> Column:
    return F.concat(F.lit('"'), *[p if not isinstance(p, str) else F.lit(p) for p in parts], F.lit('"'))


def export_graph(blocks: DataFrame, edges: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """DOT text, one line per row: a node per block, a labelled line per edge.

    Lines stay rows, so a graph of any size is written by a text sink as it is.
    ``notes(unit, block, var)`` adds live variables to the node label (debug form), as
    one extra node line per variable.
    """
    unit = F.col("unit").cast("string")
    head = blocks.select("unit").distinct().select(
        "unit", F.lit("header").alias("kind"),
        F.concat(_quoted(unit, "_header"), F.lit(' [label="Function '), unit, F.lit(':" shape="rect"]')).alias("line"),
    )
    nodes = blocks.select(
        "unit",
        F.lit("node").alias("kind"),
        F.concat(
            _quoted(unit, "_block_", F.col("block")), F.lit(' [label="block_'), F.col("block"), F.lit('" shape="rect"]')
        ).alias("line"),
    )
    lines = edges.select(
        "unit",
        F.lit("edge").alias("kind"),
        F.concat(
            _quoted(unit, "_block_", F.col("src")),
            F.lit(" -> "),
            _quoted(unit, "_block_", F.col("dst")),
            F.lit(' [label="'),
            F.col("label"),
            F.lit('"]'),
        ).alias("line"),
    )
    out = head.unionByName(nodes).unionByName(lines)
    if notes is not None:
        out = out.unionByName(
            notes.select(
                "unit",
                F.lit("live").alias("kind"),
                F.concat(
                    _quoted(unit, "_block_", F.col("block")), F.lit(' [xlabel="'), F.col("var"), F.lit('"]')
                ).alias("line"),
            )
        )
    return out
