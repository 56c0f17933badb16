"""Mixing of sources to target weights by repetition rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.positions import with_position
from flowsieve.session import cut


def word_count(text: Column) -> Column:
    """Runs of anything but white space; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def draw(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """(source, source_size, target) from (source, size): the sources share ``share`` of all sizes.

    Sources in order (null last) weigh ``weights``, repeating. A target stops at ``cap`` times its
    source's size; what is over goes to the others by weight. In each round the sources that
    stop are found with the level of the round before, and the level (target per weight) follows from
    what they leave; only three sums come to the driver.
    """
    sources = cut(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    placed = with_position(sources, F.col("source").asc_nulls_last(), "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    placed = cut(placed.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap))))

    total = placed.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = 0.0, -1
    while True:
        at_cap = F.col("most") <= F.col("weight") * F.lit(level)
        row = placed.agg(
            F.sum(F.when(at_cap, F.col("most")).otherwise(0.0)).alias("used"),
            F.sum(F.when(at_cap, 0).otherwise(F.col("weight"))).alias("open"),
            F.count_if(at_cap).alias("stopped"),
        ).first()
        if row["stopped"] == stopped or not row["open"]:
            break
        stopped = row["stopped"]
        level = (share * total - row["used"]) / row["open"]
    if not row["open"]:
        target = F.col("most")
    else:
        target = F.least(F.col("most"), F.col("weight") * F.lit(level))
    return placed.select("source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The rows of ``docs`` with the column ``mix`` (size, source_size, target, copies).

    A document's size is its number of words; its source is repeated at the rate target / source size.
    A document gets floor(rate) copies, and one more with the probability of the fraction, drawn from
    a hash of its id, so reruns agree and rows of one id are drawn alike. Null ids draw as
    an empty id; null texts have size 0; null is a source of its own; a source without words has rate 0.
    An empty table gives no rows; other columns pass through unchanged.
    """
    sized = docs.withColumn("__size", word_count(F.col(text_col).cast("string")))
    sizes = sized.select(F.col(source_col).cast("string").alias("source"), F.col("__size").alias("size"))
    targets = source_targets(sizes, weights, share, cap)
    targets = targets.select(*[F.col(c).alias(f"__{c}") for c in targets.columns])
    joined = sized.join(targets, sized[source_col].cast("string").eqNullSafe(F.col("__source")))
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(0.0)
    extra = draw(F.col(id_col), seed) < rate - F.floor(rate)
    copies = (F.floor(rate) + extra.cast("long")).cast("long")
    numbers = [F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target")]
    return joined.select(*[docs[c] for c in docs.columns if c != "mix"], F.struct(*numbers, copies.alias("copies")).alias("mix"))


def emit_copies(mixed: DataFrame) -> DataFrame:
    """Every document as many times as its copies say; the copies of a row are written where the row is."""
    plain = [c for c in mixed.columns if c != "mix"]
    counted = mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix.copies"))))
    return counted.where("mix.copies > 0").select(*plain)
