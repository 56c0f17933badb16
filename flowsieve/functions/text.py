"""Whole-text functions: canonical form, type tags, references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.session import cut

# Type names that are never resolved.
BUILT_IN_TYPES = """
self parent static int integer long float double real array object bool boolean null void false
true string mixed resource callable
""".split()

# A type tag, and a well-formed class name.
TYPE_TAG = r"@(param|return|var|type)[ \t]+(\S+)"
CLASS_NAME = r"^([a-zA-Z_\x7f-\xff][a-zA-Z0-9_\x7f-\xff]*\\)*[a-zA-Z_\x7f-\xff][a-zA-Z0-9_\x7f-\xff]*$"

# An include statement, and a link in a web page.
INCLUDE_STATEMENT = r"(include|require)(_once)?[ \t\n\r\f]*\(?(.*?)\)?;"
PAGE_LINK = r'(href|src)()="([^"]*)"'

BLANKS = " \t\n\r\0\x0b"


def canonicalise_text(text: Column) -> Column:
    """Trim, unify line ends, right-trim every line."""
    trimmed = F.trim(text, F.lit(BLANKS))
    lines = F.regexp_replace(trimmed, r"\r\n|\r", "\n")
    return F.regexp_replace(lines, r"[ \t\x0b\x00]+(?=\n|\z)", "")


def type_tags(df: DataFrame, comment: str, keys: list[str]) -> DataFrame:
    """One row per tag of a comment: its place, the tag word and the raw type text."""
    found = F.regexp_extract_all(comment, F.lit(TYPE_TAG), F.lit(0))
    return df.select(*keys, F.posexplode(found).alias("pos", "_hit")).select(
        *keys,
        "pos",
        F.regexp_extract("_hit", TYPE_TAG, 1).alias("tag"),
        F.regexp_extract("_hit", TYPE_TAG, 2).alias("raw"),
    )


def resolve_type_tags(tags: DataFrame, keys: list[str], aliases: DataFrame) -> DataFrame:
    """Resolve each part of a type (``A|B``, ``A&B``, ``?A``, ``A[]``) by an alias table.

    ``aliases(alias, target)``: built-in, malformed and unknown names stay; a leading
    backslash is dropped. The parts of one tag are put together again in their order.
    A type is resolved once, however many tags name it, so the tags themselves are not split and gathered.
    """
    tags = cut(tags.select(*keys, "pos", "tag", "raw"))
    parts = tags.select("raw").distinct().select(
        "raw", F.posexplode(F.regexp_extract_all("raw", F.lit(r"[|&]|[^|&]+"), F.lit(0))).alias("_at", "_part")
    )
    nullable = F.regexp_extract("_part", r"^(\?*)", 1)
    lists = F.regexp_extract("_part", r"((?:\[\])*)$", 1)
    core = F.expr("substring(_part, length(_head) + 1, greatest(length(_part) - length(_head) - length(_tail), 0))")
    split = parts.withColumn("_head", nullable).withColumn("_tail", lists).withColumn("_core", core)
    is_class = F.col("_core").rlike(CLASS_NAME) & ~F.lower("_core").isin(BUILT_IN_TYPES)
    lookup = aliases.select(F.lower("alias").alias("_alias"), F.col("target").alias("_target"))
    named = split.withColumn("_alias_key", F.when(is_class, F.lower("_core"))).join(
        lookup, F.col("_alias_key") == F.col("_alias"), "left"
    )
    plain = F.when(F.col("_core").startswith("\\"), F.substring("_core", F.lit(2), F.length("_core"))).otherwise(
        F.col("_core")
    )
    text = F.concat("_head", F.coalesce("_target", plain), "_tail")
    # the parts of one tag: bounded by the length of that tag
    ordered = F.array_sort(F.collect_list(F.struct("_at", text.alias("_text"))))
    resolved = named.groupBy("raw").agg(F.array_join(F.transform(ordered, lambda p: p["_text"]), "").alias("resolved"))
    return tags.join(cut(resolved), "raw").select(*keys, "pos", "tag", "raw", "resolved")


def scan_references(df: DataFrame, text: str, keys: list[str], pattern: str = INCLUDE_STATEMENT) -> DataFrame:
    """References found in a text: place, kind, once flag, path, and the matched text.

    The pattern has three groups: kind, once mark, path.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    hits = df.select(*keys, F.posexplode(found).alias("pos", "matched"))
    path = reduce(
        lambda c, drop: F.replace(c, F.lit(drop), F.lit("")),
        ["dirname(__FILE__)", "__DIR__", "'", '"', ";", ")"],
        F.regexp_extract("matched", pattern, 3),
    )
    return hits.select(
        *keys,
        "pos",
        F.regexp_extract("matched", pattern, 1).alias("kind"),
        (F.regexp_extract("matched", pattern, 2) != "").alias("once"),
        F.trim(path, F.lit(BLANKS)).alias("path"),
        "matched",
    )


def reference_segments(df: DataFrame, text: str, keys: list[str], pattern: str = INCLUDE_STATEMENT) -> DataFrame:
    """Pieces of a text between its references: ``pos``, the text before, and the reference."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = df.select(*keys, found.alias("_found"), F.posexplode(F.split(text, pattern, -1)).alias("pos", "text"))
    return pieces.select(*keys, "pos", "text", F.get("_found", F.col("pos")).alias("matched"))
