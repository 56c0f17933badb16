"""Token streams in patched frame-of-reference blocks, written to and read from shared files."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowsieve.llm.chunks import encoder
from flowsieve.llm.shipping import ready

#: Ids of one block, and ids after which a segment ends (with the document it is in).
BLOCK = 1024
SEGMENT = 1 << 18
#: Share of a block's values that the packed width must hold; the others are exceptions.
FITTING = 0.98
_HEAD = struct.Struct("<4sII")
_BLOCK_HEAD = struct.Struct("<IBH")


def pack(values: np.ndarray) -> bytes:
    """A segment: head (mark, number of values, number of blocks), byte offset of every block, blocks.

    A block holds its minimum, the width, the number of exceptions; then the low ``width`` bits
    of every value less the minimum; then the places and the high bits of the values that are
    wider. The width is the smallest that holds FITTING of the block's values.
    """
    values = np.ascontiguousarray(values, dtype=np.uint32)
    blocks = -(-len(values) // BLOCK)
    if not blocks:
        return _HEAD.pack(b"PFB1", 0, 0) + np.zeros(1, "<u4").tobytes()
    table = np.full(blocks * BLOCK, values[-1], dtype=np.uint32)
    table[: len(values)] = values
    table = table.reshape(blocks, BLOCK)
    least = table.min(axis=1)
    delta = table - least[:, None]
    bits = np.frexp(delta.astype(np.float64))[1].astype(np.uint8)
    width = np.partition(bits, int(FITTING * (BLOCK - 1)), axis=1)[:, int(FITTING * (BLOCK - 1))]
    body: list[bytes] = [b""] * blocks
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        planes = np.unpackbits(delta[rows].astype(">u4").view(np.uint8).reshape(len(rows), BLOCK, 4), axis=2)
        packed = np.packbits(planes[:, :, 32 - w :].reshape(len(rows), -1), axis=1) if w else np.zeros((len(rows), 0), np.uint8)
        wide = bits[rows] > w
        for k, row in enumerate(rows):
            places = np.flatnonzero(wide[k])
            high = delta[row, places] >> np.uint32(w) if w < 32 else np.zeros(0, np.uint32)
            body[row] = (
                _BLOCK_HEAD.pack(int(least[row]), int(w), len(places))
                + packed[k].tobytes()
                + places.astype("<u2").tobytes()
                + high.astype("<u4").tobytes()
            )
    starts = np.concatenate([[0], np.cumsum([len(b) for b in body])]).astype("<u4")
    return _HEAD.pack(b"PFB1", len(values), blocks) + starts.tobytes() + b"".join(body)


def unpack(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Values of the blocks first .. last - 1 (all by default), found through the block index."""
    mark, count, blocks = _HEAD.unpack_from(data)
    if mark != b"PFB1":
        raise ValueError("not a segment of packed blocks")
    last = blocks if last is None else min(last, blocks)
    starts = np.frombuffer(data, "<u4", blocks + 1, _HEAD.size).astype(np.int64) + _HEAD.size + 4 * (blocks + 1)
    out = np.zeros((max(0, last - first), BLOCK), dtype=np.uint32)
    heads = [_BLOCK_HEAD.unpack_from(data, starts[k]) for k in range(first, last)]
    raw = np.frombuffer(data, np.uint8)
    widths = np.array([h[1] for h in heads], dtype=np.int64)
    for w in np.unique(widths):
        rows = np.flatnonzero(widths == w)
        if w:
            size = BLOCK * w // 8
            at = starts[first + rows] + _BLOCK_HEAD.size
            packed = raw[at[:, None] + np.arange(size)]
            planes = np.zeros((len(rows), BLOCK, 32), dtype=np.uint8)
            planes[:, :, 32 - w :] = np.unpackbits(packed, axis=1).reshape(len(rows), BLOCK, w)
            out[rows] = np.packbits(planes, axis=2).view(">u4").reshape(len(rows), BLOCK)
        for row in rows:
            least, _, wide = heads[row]
            at = int(starts[first + row]) + _BLOCK_HEAD.size + BLOCK * int(w) // 8
            places = np.frombuffer(data, "<u2", wide, at)
            high = np.frombuffer(data, "<u4", wide, at + 2 * wide)
            out[row, places] |= high << np.uint32(w) if w < 32 else np.uint32(0)
            out[row] += np.uint32(least)
    return out.reshape(-1)[: max(0, min(count, last * BLOCK) - first * BLOCK)]


def _segments(path: str, keep_space: bool, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        ids: list[int | None] = []
        counts: list[int] = []
        size_held = 0

        def segment() -> pa.RecordBatch:
            values = np.concatenate(held)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()),
                    pa.array([number], pa.int32()),
                    pa.array([len(values)]),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([counts], pa.list_(pa.int64())),
                    pa.array([pack(values)], pa.binary()),
                ],
                ["shard", "segment", "n_values", "doc_ids", "doc_tokens", "payload"],
            )

        for batch in batches:
            keys = batch.column(0).to_pylist()
            texts = batch.column(1).to_pylist()
            # a few texts at a time, so that what is held follows the segment and not the batch
            row = 0
            while row < len(texts):
                end, size = row, 0
                while end < len(texts) and (end == row or size < SEGMENT):
                    size += len(texts[end] or "")
                    end += 1
                codes, at = encoder(path, keep_space).encode([t or "" for t in texts[row:end]])
                for k in range(end - row):
                    held.append(np.append(codes[at[k] : at[k + 1]], np.uint32(end_id)))
                    ids.append(keys[row + k])
                    counts.append(len(held[-1]))
                    size_held += counts[-1]
                    if size_held >= SEGMENT:
                        yield segment()
                        number += 1
                        held, ids, counts, size_held = [], [], [], 0
                row = end
        if held:
            yield segment()

    return run


def write_tokens(
    docs: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text", keep_space: bool = True, end_id: int = 0
) -> None:
    """Encode whole texts, append ``end_id`` to each and write the stream in ascending id order.

    Rows are range-partitioned by id, so a shard's ids all precede the next shard's; a shard is
    a run of segments. The files are Parquet containers of segments (payload plus its documents and
    their token counts), written through Spark's committer: a repeated task leaves one copy.
    Null texts count as empty (one end id); null ids come first; rows with equal ids are ordered by text hash.
    """
    ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    schema = "shard int, segment int, n_values long, doc_ids array<long>, doc_tokens array<long>, payload binary"
    rows.mapInArrow(_segments(path, keep_space, end_id), schema).write.option("compression", "none").parquet(folder)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            shard, number, ids, counts, payload = (batch.column(k)[row] for k in range(5))
            values = unpack(payload.as_py()).astype("<u4")
            size = np.array(counts.as_py(), dtype=np.int64)
            ends = np.cumsum(size)
            sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends - size, ends)]
            n = len(size)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, shard.as_py(), np.int32)),
                    pa.array(np.full(n, number.as_py(), np.int32)),
                    pa.array(ids.as_py(), pa.int64()),
                    pa.array(ends - size),
                    pa.array(size),
                    pa.array(np.array(sums, dtype=np.int64)),
                ],
                ["shard", "segment", "doc_id", "inside", "n_tokens", "ids_crc32"],
            )


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the packed payloads alone.

    ``start`` counts the ids of all documents before it: totals per shard are summed in shard
    order (one row per shard), totals per segment inside their shard.
    """
    files = ready(spark).read.parquet(folder)
    sizes = files.select("shard", "segment", "n_values")
    shards = sizes.groupBy("shard").agg(F.sum("n_values").alias("all"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("shard_start"))
    inside = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    segments = sizes.select("shard", "segment", F.coalesce(F.sum("n_values").over(inside), F.lit(0)).alias("segment_start"))
    docs = files.select("shard", "segment", "doc_ids", "doc_tokens", "payload").mapInArrow(
        _read, "shard int, segment int, doc_id long, inside long, n_tokens long, ids_crc32 long"
    )
    placed = docs.join(segments.join(shards, "shard"), ["shard", "segment"])
    start = F.col("shard_start") + F.col("segment_start") + F.col("inside")
    return placed.select("doc_id", start.alias("start"), "n_tokens", "ids_crc32")
