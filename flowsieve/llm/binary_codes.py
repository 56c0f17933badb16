"""Near-duplicate vectors by randomised-rotation binary codes with stored correction factors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.components import components
from flowsieve.llm.hashing import U, mix
from flowsieve.llm.shipping import ready
from flowsieve.llm.topk import finite
from flowsieve.session import cut

#: Bands and bits of a band. At a cosine of 0.98 a bit differs with probability 0.064, so a pair
#: shares a band with probability 0.45, and none of 24 with 5e-7; closer pairs with far less.
BANDS, BAND_BITS = 24, 12
#: Rows of a block of a bucket; a larger bucket is dealt into blocks and compared block by block.
BLOCK_ROWS = 512
#: Rows that a task takes at once, and buckets up to this size are compared together.
BIN_ROWS, SMALL = 8192, 48
#: Deviations of the unbiased estimate that its confidence bound allows for (probability 2e-9).
DEVIATIONS = 6.0


def rotations(size: int, bits: int, seed: int = 7) -> np.ndarray:
    """Random rotations side by side: (size, bits) with orthonormal columns in each run of ``size``."""
    make = np.random.default_rng(seed)
    parts = [np.linalg.qr(make.standard_normal((size, size)))[0] for _ in range(-(-bits // size))]
    return np.concatenate(parts, axis=1)[:, : max(bits, size)]


def _encode(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn: dict[int, np.ndarray] = {}
        for batch in batches:
            lists = batch.column(3)
            sizes = np.diff(lists.offsets.to_numpy())
            for size in np.unique(sizes):
                rows = pa.array(np.flatnonzero(sizes == size))
                part = batch.take(rows)
                x = part.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
                if size not in turn:
                    turn[size] = rotations(int(size), bits)
                rotated = x @ turn[size]
                signs = rotated >= 0
                # first rotation: the code whose distance estimates use, and the cosine between vector and code
                factor = np.abs(rotated[:, :size]).sum(axis=1) / np.sqrt(size)
                code = np.packbits(signs[:, :size], axis=1)
                keys = signs[:, :bits].reshape(len(x), BANDS, BAND_BITS) @ (1 << np.arange(BAND_BITS))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        part.column(2),
                        pa.array([v.tobytes() for v in x], pa.binary()),
                        pa.array([c.tobytes() for c in code], pa.binary()),
                        pa.array(factor),
                        pa.array(list(keys.astype(np.int16)), pa.list_(pa.int16())),
                    ],
                    ["label", "rep", "many", "vector", "code", "factor", "bands"],
                )

    return run


def may_link(b: np.ndarray, factor: np.ndarray, size: int, least: float) -> np.ndarray:
    """Whether the cosine can reach ``least``; b is the inner product of one vector with the other's code.

    b / factor estimates the cosine without bias. Its confidence bound is DEVIATIONS times
    sqrt((1 - factor^2) / factor^2 / (size - 1)); beside it, the angles between vector, code and
    the other vector give a bound that always holds.
    """
    estimate = b / factor
    bound = DEVIATIONS * np.sqrt(np.maximum(0.0, 1 - factor**2)) / factor / np.sqrt(max(1, size - 1))
    angle = np.arccos(np.clip(b, -1, 1)) - np.arccos(np.clip(factor, -1, 1))
    return (estimate + bound >= least) & (np.abs(angle) <= np.arccos(least) + 1e-6)


def _pairs(unit: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i < j) of rows to compare in each unit; rows are sorted by unit and side.

    Sides: 0 a block with itself, 1 and 2 two blocks of a bucket that are compared with each other.
    """
    edges = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1], [True]]))
    sizes = np.diff(edges)
    reach = int(min(SMALL, sizes.max(initial=0)))
    small = np.repeat(sizes <= SMALL, sizes)
    for gap in range(1, reach):
        i = np.flatnonzero((unit[gap:] == unit[:-gap]) & small[gap:] & ((side[gap:] == 0) | (side[gap:] != side[:-gap])))
        if len(i):
            yield i, i + gap
    for k in np.flatnonzero(sizes > SMALL):
        a, b = edges[k], edges[k + 1]
        middle = a + int(np.searchsorted(side[a:b], 2))
        if side[a] == 0:
            for row in range(a, b, 128):
                i, j = np.meshgrid(np.arange(row, min(row + 128, b)), np.arange(row + 1, b), indexing="ij")
                up = i < j
                yield i[up], j[up]
        elif a < middle < b:
            for row in range(a, middle, 128):
                i, j = np.meshgrid(np.arange(row, min(row + 128, middle)), np.arange(middle, b), indexing="ij")
                yield i.reshape(-1), j.reshape(-1)


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links that keep the components of all links (a, b), at most one per node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


def _compare(least: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["unit", "side"], kind="stable")
        unit, side = rows["unit"].to_numpy(), rows["side"].to_numpy()
        rep, many = rows["rep"].to_numpy(), rows["many"].to_numpy()
        band, factor = rows["band"].to_numpy(), rows["factor"].to_numpy()
        bands = np.stack(rows["bands"].to_numpy())
        lengths = rows["vector"].map(len).to_numpy()
        out_id, out_n, links = [], [], []
        sizes = np.unique(lengths)
        vectors = np.zeros((len(rows), int(sizes.max()) // 8))
        codes = np.zeros_like(vectors)
        for length in sizes:
            at, size = np.flatnonzero(lengths == length), int(length) // 8
            vectors[at, :size] = np.frombuffer(b"".join(rows["vector"].to_numpy()[at])).reshape(-1, size)
            packed = np.frombuffer(b"".join(rows["code"].to_numpy()[at]), np.uint8).reshape(len(at), -1)
            codes[at, :size] = (2.0 * np.unpackbits(packed, axis=1)[:, :size] - 1) / np.sqrt(size)
        turned = {int(length) // 8: rotations(int(length) // 8, 1)[:, : int(length) // 8] for length in sizes}
        rotated = np.zeros_like(vectors)
        for size, turn in turned.items():
            at = np.flatnonzero(lengths == 8 * size)
            rotated[at, :size] = vectors[at, :size] @ turn
        for left, right in _pairs(unit, side):
            for first in range(0, len(left), 1 << 16):
                i, j = left[first : first + (1 << 16)], right[first : first + (1 << 16)]
                # the first band that both share decides; the others leave the pair to it
                ok = np.argmax(bands[i] == bands[j], axis=1) == band[i]
                ok &= (rep[i] != rep[j]) & (lengths[i] == lengths[j])
                i, j = i[ok], j[ok]
                b = np.einsum("ij,ij->i", rotated[i], codes[j])
                size = lengths[j] // 8
                ok = may_link(b, factor[j], int(size.min()) if len(size) else 2, least)
                i, j = i[ok], j[ok]
                ok = np.einsum("ij,ij->i", vectors[i], vectors[j]) >= least
                i, j = i[ok], j[ok]
                if len(i):
                    out_id += [rep[i], rep[j]]
                    out_n += [many[j], many[i]]
                    links += _forest(rep[i], rep[j])
        if not out_id:
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)})
        ids, place = np.unique(np.concatenate(out_id), return_inverse=True)
        count = np.bincount(place, weights=np.concatenate(out_n)).astype(np.int64)
        tied = _forest(*(np.array(x, dtype=np.int64) for x in zip(*links)))
        return pd.DataFrame(
            {
                "a": np.concatenate([ids, [x for x, _ in tied]]).astype(np.int64),
                "b": np.concatenate([ids, [y for _, y in tied]]).astype(np.int64),
                "n": np.concatenate([count, np.zeros(len(tied), np.int64)]),
            }
        )

    return run


def near_vectors(
    vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row; vectors of one label link at a cosine of ``least``.

    1. Equal vectors of a label are one class: its members are linked, its smallest id goes on.
    2. Every vector is rotated at random; the signs are its code, the inner product of vector and code its
       correction factor. Bands of the signs (of several rotations) are the buckets in which pairs meet.
    3. In a bucket, one vector's inner product with the other's code, divided by the factor, estimates the
       cosine without bias; pairs whose confidence bound reaches ``least`` are computed exactly, in
       the first bucket they share. A bucket of many vectors is dealt into blocks, and each pair
       of blocks is work of its own. Only counts per vector and the links of a spanning forest
       leave a task, never all pairs.

    Links are exact (double precision); a pair at the threshold is missed with probability 5e-7. Vectors that
    are null, empty, zero or hold null or non-finite components, null labels and null ids link with
    nothing. Rows with one id and several vectors are one node; repeated rows are other vectors
    that are linked. Vectors of different length don't link. An empty table gives no rows.
    """
    ready(vectors.sparkSession)
    bits = BANDS * BAND_BITS
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).cast("array<double>").alias("v"),
    )
    usable = finite(F.col("v")) & F.exists("v", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = cut(rows.withColumn("v", F.when(usable, F.col("v"))))
    same = cut(rows.where("v IS NOT NULL").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("many")))

    schema = "label string, rep long, many long, vector binary, code binary, factor double, bands array<short>"
    coded = cut(same.select("label", "rep", "many", "v").mapInArrow(_encode(bits), schema))
    keyed = coded.select("*", F.posexplode("bands").alias("band", "key"))
    counts = coded.select("label", F.posexplode("bands").alias("band", "key")).groupBy("label", "band", "key")
    counts = cut(counts.agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"))
    dealt = keyed.join(counts, ["label", "band", "key"])
    blocks = F.ceil(F.col("rows") / BLOCK_ROWS).cast("int")
    own = F.pmod(F.xxhash64("rep", "code"), blocks).cast("int")
    dealt = dealt.withColumns({"blocks": blocks, "own": own})
    # one piece of work per pair of blocks of a bucket: the block with itself (side 0), or two blocks (1 and 2)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.withColumn("other", other).withColumns(
        {
            "side": F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2),
            "unit": F.xxhash64("label", "band", "key", F.least("own", "other"), F.greatest("own", "other")),
        }
    )
    work = dealt.select("unit", "side", "rep", "many", "band", "factor", "bands", "vector", "code")
    expected = counts.agg(F.sum(F.col("rows") * F.ceil(F.col("rows") / BLOCK_ROWS))).first()[0] or 0
    bins = max(1, -(-int(expected) // BIN_ROWS))
    found = work.groupBy(F.pmod("unit", F.lit(bins)).alias("bin")).applyInPandas(_compare(least), "a long, b long, n long")
    found = cut(found)

    linked = found.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    members = rows.select("vec_id", "label", "v").join(same, ["label", "v"], "left")
    edges = found.where("a <> b").select("a", "b").unionByName(_same_id(members))
    known = cut(components(edges)).withColumnRenamed("node", "rep")
    out = members.select("vec_id", "rep", "many").join(cut(linked), "rep", "left").join(known, "rep", "left")
    links = F.coalesce(F.col("many") - 1 + F.coalesce("others", F.lit(0)), F.lit(0)).cast("long")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "rep", "vec_id"))
    out = out.select("vec_id", links.alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _same_id(members: DataFrame) -> DataFrame:
    """Links between the classes of an id that comes with several vectors."""
    seen = members.where("rep IS NOT NULL")
    several = seen.groupBy("vec_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi")
    return several.select(F.col("lo").alias("a"), F.col("hi").alias("b"))
