"""Near-duplicate documents by SuperMinHash signatures, banding, exact verification and grouping."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.components import components
from flowsieve.llm.hashing import ODD, U, mix, shingles, slices, words
from flowsieve.llm.shipping import ready
from flowsieve.session import cut, cut_counted

#: Slots of a signature: a prime, so that (a * step + b) mod SLOTS runs through every slot once.
SLOTS = 131
#: Slots that bands use: 32 bands of 4. A pair of similarity 0.75 shares no band with probability 6e-6.
BANDS, ROWS = 32, 4
USED = BANDS * ROWS
#: The slots of the bands in an order of chance: an element visits the slots in steps of one width, so slots next
#: to each other are not independent of each other.
PLACES = np.random.default_rng(29).permutation(SLOTS)[:USED]
#: The bands are made for similarities from this on (in percent); below it too many pairs would share none.
LEAST_PERCENT = 75
#: Sets of up to so many shingles are also looked up exactly: a link between such sets is one set within the other
#: that has one shingle more, so they meet under the key of the smaller one.
SMALL = 5
#: Bytes and rows of sets that a block of a bucket holds at about most, and bytes of a task.
BLOCK_BYTES, BLOCK_ROWS, TASK_BYTES = 4 << 20, 1024, 16 << 20


def least_equal(percent: int) -> int:
    """Equal slots of USED that a pair must have to be compared in full: five deviations below their mean.

    The ranks of an element are spread without repetition, which makes the deviation no larger than that
    of independent slots; a linked pair is below with probability under 1e-6.
    """
    share = min(100, percent) / 100
    return int(USED * share - 5 * np.sqrt(USED * share * (1 - share)))


def signatures(elements: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """SuperMinHash of each set (elements[offsets[i]:offsets[i+1]]) as a row of SLOTS 64-bit values.

    Every element visits the slots in an order of its own, one slot in each step, and leaves there
    the step's rank with a random fraction below it. The ranks of one element over the slots are
    thus a permutation (pairwise as a uniform one), which lowers the variance against
    independent minima. A set is done as soon as the worst of its slots holds a rank that no
    later step can lower. An empty set keeps the largest value in all slots.
    """
    sets = len(offsets) - 1
    out = np.full((sets, SLOTS), U(0xFFFFFFFFFFFFFFFF), dtype=np.uint64)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(sets), np.diff(offsets))
    with np.errstate(over="ignore"):
        step = (1 + mix(elements ^ U(0xA5A5A5A5A5A5A5A5)) % U(SLOTS - 1)).astype(np.int64)
        slot = (mix(elements + U(0x5851F42D4C957F2D)) % U(SLOTS)).astype(np.int64)
        for rank in range(SLOTS):
            if not len(owner):
                break
            fraction = mix(elements + ODD * U(rank + 1)) >> U(8)
            np.minimum.at(flat, owner * SLOTS + slot, (U(rank) << U(56)) | fraction)
            open_sets = np.zeros(sets, dtype=bool)
            active = np.unique(owner)
            open_sets[active] = (out[active].max(axis=1) >> U(56)) > U(rank)
            keep = open_sets[owner]
            elements, owner, step, slot = elements[keep], owner[keep], step[keep], slot[keep]
            slot = (slot + step) % SLOTS
    return out


def short_slots(signature: np.ndarray) -> np.ndarray:
    """16 bits of each slot that bands use; what is equal in the signature is equal here."""
    with np.errstate(over="ignore"):
        return (mix(signature[:, PLACES]) >> U(17)).astype("<u2")


def band_keys(short: np.ndarray) -> np.ndarray:
    """A key per band, from its short slots alone: two rows have the same key if and only if (but for 64-bit
    collisions) they agree in the band's short slots, so tasks can tell from these which bands a pair shares."""
    parts = np.ascontiguousarray(short).reshape(len(short), BANDS, ROWS).view("<u8")[:, :, 0]
    with np.errstate(over="ignore"):
        return mix(mix(parts) + np.arange(BANDS, dtype=np.uint64) * ODD).view(np.int64)


def small_keys(items: np.ndarray) -> np.ndarray | None:
    """Keys of a small set and of the sets that lack one of its shingles; null for larger ones."""
    if not 0 < len(items) <= SMALL + 1:
        return None
    with np.errstate(over="ignore"):
        each = mix(items + ODD)
        return mix(np.append(each.sum() - each, each.sum())).view(np.int64)


def _mark(items: np.ndarray) -> bytes:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


def _describe(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row_number = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for row, end, data, offsets in slices(texts):
                runs, at = shingles(*words(data, offsets), size)
                sets = [np.unique(runs[a:b]) for a, b in zip(at[:-1], at[1:])]
                counts = np.array([len(s) for s in sets], dtype=np.int64)
                marks = [_mark(s) for s in sets]
                signature = signatures(np.concatenate(sets), np.concatenate([[0], np.cumsum(counts)]))
                short = short_slots(signature)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(row, end - row).cast(pa.int64()),
                        pa.array(row_number + np.arange(end - row)),
                        pa.array(counts),
                        pa.array(marks, pa.binary()),
                        pa.array(np.frombuffer(b"".join(marks), "<i8")[::2]),
                        pa.array([x.tobytes() for x in short], pa.binary()),
                        pa.array([small_keys(s) for s in sets], pa.list_(pa.int64())),
                    ],
                    ["id", "row", "n", "mark", "c", "slots", "small"],
                )
                row_number += end - row

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                runs, at = shingles(*words(data, offsets), size)
                sets = [np.unique(runs[a:b]).tobytes() for a, b in zip(at[:-1], at[1:])]
                marks = [hashlib.blake2b(s, digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(marks, pa.binary()), pa.array(sets, pa.binary())], ["mark", "items"])

    return run


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per band of every class, and one per key of a small set."""
    for batch in batches:
        if batch.num_rows:
            short = np.frombuffer(b"".join(batch.column("slots").to_pylist()), "<u2").reshape(-1, USED)
            c = np.repeat(batch.column("c").to_numpy(), BANDS)
            band = np.tile(np.arange(BANDS, dtype=np.int32), batch.num_rows)
            keys = band_keys(short).reshape(-1)
            small = batch.column("small")
            owner = pc.list_parent_indices(small).to_numpy()
            c = np.concatenate([c, batch.column("c").to_numpy()[owner]])
            band = np.concatenate([band, np.full(len(owner), BANDS, np.int32)])
            keys = np.concatenate([keys, small.flatten().to_numpy()])
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(band), pa.array(keys)], ["c", "band", "key"])


def _alike(one: np.ndarray, two: np.ndarray, n_one, n_two, percent: int) -> np.ndarray:
    """Sizes and the number of equal slots allow the similarity."""
    sizes = 100 * np.minimum(n_one, n_two) >= percent * np.maximum(n_one, n_two)
    return sizes & (((one == two).sum(axis=-1) >= least_equal(percent)) | (np.minimum(n_one, n_two) <= SMALL))


def _promising(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(-1, USED) for k in ("slots", "other_slots"))
            keep = _alike(one, two, batch.column("n").to_numpy(), batch.column("other_n").to_numpy(), percent)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep)) for k in ("a", "b")], ["a", "b"])

    return run


def _linked(both: int, n_one: int, n_two: int, percent: int) -> bool:
    return 100 * both >= percent * (n_one + n_two - both)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for left, right in zip(batch.column("left"), batch.column("right")):
                one, two = (np.frombuffer(x.as_py(), dtype=np.uint64) for x in (left, right))
                both = len(np.intersect1d(one, two, assume_unique=True))
                good.append(_linked(both, len(one), len(two), percent))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return run


def _compare_unit(rows: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links between members of different components of one unit (a block, or two blocks, of a bucket)."""
    c, n, part = (rows[k].to_numpy() for k in ("c", "n", "component"))
    side, band = rows["side"].to_numpy(), int(rows["band"].iloc[0])
    slots = np.frombuffer(b"".join(rows["slots"]), "<u2").reshape(-1, USED)
    items = [np.frombuffer(x, dtype=np.uint64) for x in rows["items"]]
    middle = int(np.searchsorted(side, 2))
    vocabulary, codes = np.unique(np.concatenate(items), return_inverse=True)
    codes = np.split(codes, np.cumsum([len(x) for x in items])[:-1])
    here = np.zeros(len(vocabulary), dtype=bool)
    found = []
    for i in range(len(rows) if side[0] == 0 else middle):
        others = np.arange(i + 1, len(rows)) if side[0] == 0 else np.arange(middle, len(rows))
        others = others[part[others] != part[i]]
        equal = slots[others] == slots[i]
        # a pair is compared in the first band that it shares, small sets wherever they meet exactly
        shared = (np.argmax(equal.reshape(-1, BANDS, ROWS).all(axis=2), axis=1) == band) | (band == BANDS)
        others = others[shared & _alike(slots[others], slots[i], n[others], n[i], percent)]
        if len(others):
            here[codes[i]] = True
            for j in others:
                if _linked(int(here[codes[j]].sum()), n[i], n[j], percent):
                    found.append((int(c[i]), int(c[j])))
            here[codes[i]] = False
    return found


def _compare(percent: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["unit", "side"], kind="stable")
        links = [link for _, unit in rows.groupby("unit", sort=False) if len(unit) > 1 for link in _compare_unit(unit, percent)]
        return pd.DataFrame(links or None, columns=["a", "b"], dtype="int64")

    return run


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Sets of distinct ``size``-word shingles are compared by Jaccard similarity; documents with at
    least ``percent`` / 100 are linked, and a component is named by its smallest id.

    1. Every text gets its set's fingerprint and SuperMinHash signature, once, in one scan. Documents
       with equal sets are one class; one row of a class goes on, so copies cost nothing further.
    2. Every member of a band's bucket is compared with the bucket's first: one pair per member,
       however large the bucket. Pairs whose signatures allow the similarity are confirmed on the whole
       sets; the confirmed ones give first components.
    3. Buckets whose members are still in several components are compared inside tasks, with the sets
       at hand: all members of different components, each pair in the first band it shares. A large
       bucket is dealt into blocks, and each pair of blocks is work of its own. Only links leave a
       task, and they are few, since what hangs together was found before.

    Links are confirmed on the whole sets (as sets of 64-bit hashes). Null or blank texts have size 0
    and are linked with nothing. Rows with one id and several texts are one node that has the links of
    all of them. Rows with a null id are returned with a null component and kept. An empty table
    gives no rows; other columns of ``docs`` are not used. A ``percent`` below LEAST_PERCENT raises an error.
    """
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent must lie between {LEAST_PERCENT} and 100")
    ready(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, row long, n long, mark binary, c long, slots binary, small array<long>"
    described = cut(texts.mapInArrow(_describe(size), schema))
    full = described.where("n > 0 AND id IS NOT NULL")
    classes = cut(full.groupBy("mark").agg(F.min("id").alias("rep"), F.min("row").alias("row")))
    heads = cut(full.drop("id").join(classes, ["mark", "row"]))

    members = heads.select("c", "slots", "small").mapInArrow(_members, "c long, band int, key long")
    buckets = members.groupBy("key").agg(F.min("c").alias("first"), F.max("c").alias("last")).where("first < last")
    members = cut(members.join(buckets.select("key", "first"), "key"))
    star = members.where("first < c").select(F.col("first").alias("a"), F.col("c").alias("b")).distinct()
    detail = heads.select("c", "n", "slots")
    star = star.join(detail.withColumnRenamed("c", "b"), "b").join(
        detail.select(F.col("c").alias("a"), F.col("n").alias("other_n"), F.col("slots").alias("other_slots")), "a"
    )
    star = cut(star.mapInArrow(_promising(percent), "a long, b long"))

    # the sets of whatever shares a bucket, from the texts of those documents only
    sharing = members.select("c").distinct().join(heads.select("c", "mark", F.col("rep").alias("id")), "c")
    sharing = cut(sharing)
    items = texts.join(sharing.select("id").distinct(), "id", "left_semi").select("text")
    items = items.mapInArrow(_sets(size), "mark binary, items binary").groupBy("mark").agg(F.max("items").alias("items"))
    items = cut(items.join(sharing.select("c", "mark"), "mark").select("c", "items"))
    pairs = star.join(items.select(F.col("c").alias("b"), F.col("items").alias("right")), "b")
    pairs = pairs.join(items.select(F.col("c").alias("a"), F.col("items").alias("left")), "a")
    first = cut(
        pairs.select("a", "b", "left", "right").mapInArrow(_confirm(percent), "a long, b long").unionByName(_same_id(full))
    )
    known = cut(components(first)).withColumnRenamed("node", "c")

    second, more = cut_counted(_rest(members, known, heads, items, percent))
    if more:
        known = components(known.select(F.col("c").alias("a"), F.col("component").alias("b")).unionByName(second))
        known = known.withColumnRenamed("node", "c")
    named = cut(known.join(heads.select("c", "rep"), "c").drop("c"))
    names = named.groupBy("component").agg(F.min("rep").alias("name"))
    named = named.join(names, "component").select("rep", "name").distinct()
    named = named.groupBy("rep").agg(F.min("name").alias("name"))

    rows = described.select("id", "mark", F.col("n").alias("n_shingles")).join(classes.drop("row"), "mark", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("name", "rep", "id"))
    out = rows.join(cut(named), "rep", "left").select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _rest(members: DataFrame, known: DataFrame, heads: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that the first members of buckets didn't show."""
    spark = members.sparkSession
    placed = members.where("first < c").join(known, "c", "left")
    placed = cut(placed.select("key", "band", "c", F.coalesce("component", "c").alias("component")))
    several = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    rest = placed.join(several.select("key"), "key", "left_semi").join(heads.select("c", "n", "slots"), "c")
    rest = cut(rest.select("key", "band", "c", "component", "n"))
    loads = rest.groupBy("key").agg(F.sum(8 * F.col("n") + 600).alias("bytes"), F.count(F.lit(1)).alias("rows"))
    blocks = F.greatest(F.ceil(F.col("bytes") / BLOCK_BYTES), F.ceil(F.col("rows") / BLOCK_ROWS))
    loads = loads.select("key", blocks.cast("int").alias("blocks"), "bytes")
    dealt = rest.join(cut(loads), "key").withColumn("own", F.pmod(F.xxhash64("c", "key"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns(
        {
            "side": F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2),
            "unit": F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")),
        }
    )
    work = dealt.select("unit", "side", "band", "c", "component", "n")
    total = loads.agg(F.sum(F.col("bytes") * F.col("blocks"))).first()[0] or 0
    tasks = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // TASK_BYTES))
    work = work.join(heads.select("c", "slots"), "c").join(items, "c")
    return work.groupBy(F.pmod("unit", F.lit(tasks)).alias("task")).applyInPandas(_compare(percent), "a long, b long")


def _same_id(rows: DataFrame) -> DataFrame:
    """Links between the classes of an id that comes with several texts."""
    several = rows.groupBy("id").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi")
    return rows.join(several.select("id", "lo"), "id").where("lo < c").select(F.col("lo").alias("a"), F.col("c").alias("b"))
