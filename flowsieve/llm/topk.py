"""Exact top-k search by distributed histogram selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.llm.shipping import ready
from flowsieve.session import cut

#: Queries of a block: what is broadcast at once is this many vectors, whatever the table's size.
BLOCK = 4096
#: Bins of a histogram; each round narrows the range that holds the kth value by this factor.
BINS = 128
#: Scores (queries times candidates) that a task holds at once.
SCORES = 1 << 21


def finite(vector: Column) -> Column:
    """The vector is there and has no null, NaN or infinite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad, F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors as rows; shorter ones are filled up with zeros."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = values
    return out


def _scores(batches: Iterator[pa.RecordBatch], matrix: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(candidate ids, their scores by query) for slices of the candidates; integers are exact below 2**53."""
    step = max(1, SCORES // max(1, len(matrix)))
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        vectors = _matrix(batch.column(1))
        width = min(matrix.shape[1], vectors.shape[1])
        for a in range(0, len(ids), step):
            yield ids[a : a + step], matrix[:, :width] @ vectors[a : a + step, :width].T


def _histogram(block, low, high, width):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = block.value
        counts = np.zeros((len(ids), BINS), dtype=np.int64)
        base = np.arange(len(ids))[:, None] * BINS
        for others, scores in _scores(batches, matrix):
            bins = np.floor((scores - low[:, None]) / width).astype(np.int64)
            seen = (bins >= 0) & (scores < high[:, None]) & (ids[:, None] != others[None, :])
            counts += np.bincount((bins + base)[seen], minlength=counts.size).reshape(counts.shape)
        row, place = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(row), pa.array(place), pa.array(counts[row, place])], ["query", "bin", "n"]
        )

    return run


def _above(block, least):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = block.value
        for others, scores in _scores(batches, matrix):
            row, place = np.nonzero((scores >= least[:, None]) & (ids[:, None] != others[None, :]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[row]), pa.array(others[place]), pa.array(scores[row, place].astype(np.int64))],
                ["query_id", "vec_id", "score"],
            )

    return run


def _reach(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = block.value
        top = np.full(len(ids), -np.inf)
        low = np.full(len(ids), np.inf)
        for _, scores in _scores(batches, matrix):
            top = np.maximum(top, scores.max(axis=1))
            low = np.minimum(low, scores.min(axis=1))
        if np.isfinite(top).all():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(ids))), pa.array(low.astype(np.int64)), pa.array(top.astype(np.int64))],
                ["query", "low", "top"],
            )

    return run


def _limits(candidates: DataFrame, block, n: int, k: int) -> np.ndarray:
    """The kth highest score of every query of the block (or its lowest, if there are fewer others).

    The range of scores is divided into BINS; the bin that holds the kth value becomes the next range,
    until a bin is one integer wide. Tasks count their own candidates, Spark adds the counts up.
    """
    low, top = np.zeros(n), np.zeros(n)
    reach = candidates.mapInArrow(_reach(block), "query long, low long, top long")
    reach = reach.groupBy("query").agg(F.min("low").alias("low"), F.max("top").alias("top")).toArrow()
    low[reach["query"].to_numpy()], top[reach["query"].to_numpy()] = reach["low"].to_numpy(), reach["top"].to_numpy()
    high = top + 1
    width = max(1, -(-int((high - low).max()) // BINS))
    wanted = np.full(n, k, dtype=np.int64)
    while True:
        counts = np.zeros((n, BINS), dtype=np.int64)
        found = candidates.mapInArrow(_histogram(block, low, high, width), "query long, bin long, n long")
        summed = found.groupBy("query", "bin").agg(F.sum("n").alias("n")).toArrow()
        counts[summed["query"].to_numpy(), summed["bin"].to_numpy()] = summed["n"].to_numpy()
        above = np.cumsum(counts[:, ::-1], axis=1)
        place = np.argmax(above >= wanted[:, None], axis=1)
        place[above[:, -1] < wanted] = BINS - 1
        wanted = wanted - np.where(place > 0, above[np.arange(n), place - 1], 0)
        low = low + (BINS - 1 - place) * width
        if width == 1:
            return low
        high = np.minimum(high, low + width)
        width = -(-width // BINS)


def top_scores(
    vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest integer inner products of each query.

    Components become floor(scale * x). The queries come in blocks of BLOCK vectors; a block is
    broadcast and every candidate is scored where it lies, so candidates are never shuffled. Per
    block, histograms of all scores are refined until each query's kth score is known exactly; a last
    pass keeps the scores that reach it, and ties go to the smaller id. The driver holds one block,
    its histograms and nothing else.

    Vectors that are null, empty or hold null or non-finite components take no part, nor do rows with a null id;
    rows with the query's id are its own and no candidates for it. Repeated queries are one query
    (the rows of one id must be equal; otherwise the row with the largest vector counts); repeated
    candidates are ranked one by one. Of vectors of different length the shorter counts as filled up with zeros.
    Fewer than ``k`` others: all. Products are exact as long as their sums stay below 2**53.
    """
    spark = ready(vectors.sparkSession)
    numbers = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    rows = vectors.where(finite(F.col(vector_col)) & F.col(id_col).isNotNull())
    marked = rows.select(F.col(id_col).cast("long").alias("vec_id"), numbers.alias("v"), is_query.alias("asks"))
    candidates = cut(marked)
    queries = candidates.where("asks").groupBy("vec_id").agg(F.max("v").alias("v"))
    candidates = candidates.select("vec_id", "v")

    parts, last = [], None
    queries = cut(queries.repartitionByRange("vec_id").sortWithinPartitions("vec_id"))
    while True:
        rest = queries if last is None else queries.where(F.col("vec_id") > last)
        rows = rest.orderBy("vec_id").limit(BLOCK).collect()
        if not rows:
            break
        last = rows[-1]["vec_id"]
        ids = np.array([r["vec_id"] for r in rows], dtype=np.int64)
        block = spark.sparkContext.broadcast((ids, _matrix(pa.array([r["v"] for r in rows], pa.list_(pa.float64())))))
        least = _limits(candidates, block, len(ids), k)
        found = candidates.mapInArrow(_above(block, least), "query_id long, vec_id long, score long")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        parts.append(cut(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("query_id", "rank", "vec_id", "score")
