"""Transitive expansion of references between texts."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.session import cut, cut_counted


def expand_references(refs: DataFrame, files: DataFrame, roots: DataFrame) -> DataFrame:
    """Breadth-first inclusion tree of each root.

    ``refs(name, pos, path, once)`` are the references of each file, ``files(name)``
    the files there are. Gives per inclusion root, level, ``place`` (positions from the
    root), target, once, status: ``expanded``; ``skipped`` for a once-reference whose
    target came before (earlier level, or earlier place in this one); ``missing``;
    ``cycle`` for a plain reference to a file it is itself inside.
    """
    links = refs.select(F.col("name").alias("_file"), "pos", "path", "once")
    there = files.select(F.col("name").alias("target"), F.lit(True).alias("_there"))
    opened = roots.select(
        F.col("name").alias("root"), F.array().cast("array<int>").alias("place"),
        F.array("name").alias("chain"), F.col("name").alias("target"),
    )
    included = opened.select("root", "target").where(F.lit(False))
    tree = None
    for level in itertools.count(1):
        met = opened.join(links, F.col("target") == F.col("_file")).select(
            "root",
            F.array_append("place", F.col("pos")).alias("place"),
            "chain",
            F.col("path").alias("target"),
            "once",
        )
        met = met.join(there, "target", "left")
        first = (
            met.where("_there").groupBy("root", "target").agg(F.min("place").alias("_first"))
            .join(included, ["root", "target"], "left_anti")
        )
        status = (
            F.when(F.col("_there").isNull(), "missing")
            .when(F.col("once") & (F.col("_first").isNull() | (F.col("place") != F.col("_first"))), "skipped")
            .when(F.array_contains("chain", F.col("target")), "cycle")
            .otherwise("expanded")
        )
        judged, rows = cut_counted(
            met.join(first, ["root", "target"], "left")
            .withColumn("status", status)
            .withColumn("level", F.lit(level))
            .select("root", "level", "place", "target", "once", "status", "chain")
        )
        if rows == 0:
            break
        done = judged.drop("chain")
        tree = done if tree is None else tree.unionByName(done)
        opened = judged.where("status = 'expanded'").select(
            "root", "place", F.array_append("chain", F.col("target")).alias("chain"), "target"
        )
        included = cut(
            included.unionByName(judged.where("status <> 'missing'").select("root", "target")).distinct()
        )
    return judged.drop("chain") if tree is None else tree


def expanded_source(tree: DataFrame, segments: DataFrame, roots: DataFrame) -> DataFrame:
    """Pieces of each root's full text in reading order, as rows ``(root, place, text)``.

    ``segments(name, pos, text, matched)``: the text before reference ``pos`` and the
    reference itself; the last piece of a file has no reference. A missing target
    leaves the reference as it was; skipped and circular ones leave nothing.
    """
    inside = tree.where("status = 'expanded'").select("root", "place", F.col("target").alias("name")).unionByName(
        roots.select(F.col("name").alias("root"), F.array().cast("array<int>").alias("place"), "name")
    )
    # a piece stands just before the reference that follows it
    texts = inside.join(segments, "name").select(
        "root", F.concat("place", F.array(F.col("pos"), F.lit(-1))).alias("place"), "text"
    )
    kept = tree.where("status = 'missing'").select("root", "place")
    owners = inside.select("root", F.col("place").alias("_at"), "name")
    asked = kept.withColumn("_at", F.slice("place", F.lit(1), F.size("place") - 1)).withColumn(
        "pos", F.element_at("place", -1)
    )
    stays = (
        asked.join(owners, ["root", "_at"])
        .join(segments.select("name", "pos", "matched"), ["name", "pos"])
        .select("root", F.array_append("place", F.lit(0)).alias("place"), F.col("matched").alias("text"))
    )
    return texts.unionByName(stays)
