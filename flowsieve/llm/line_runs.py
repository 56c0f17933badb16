"""Removal of repeated lines with levelled sorted runs of line hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.llm.shipping import ready
from flowsieve.session import cut, new_folder

#: Batches a table is read in, and runs of a level that are compacted into one run of the next level.
BATCHES, FANOUT = 4, 2
EDGES = " \t\n\x0b\x0c\r"


def line_key(line: str, min_chars: int) -> bytes | None:
    """128-bit hash of the line without white space at its ends and with A-Z lower-cased; None if it is short."""
    line = line.strip(EDGES)
    return hashlib.blake2b(line.encode("utf-8").lower(), digest_size=16).digest() if len(line) >= min_chars else None


class LineRuns:
    """Sorted runs of (key, n_docs, top): in how many documents a key was seen and the largest id of them.

    Runs of level 0 come from one batch each; FANOUT runs of a level are merged into a run of the next,
    so the runs to look at grow with the logarithm of the number of batches. A run is a Parquet
    folder clustered and sorted by key in the shared folder, never changed once it is written.
    """

    schema = "key binary, n_docs long, top long"

    def __init__(self, spark: SparkSession, min_docs: int) -> None:
        self.spark, self.min_docs = spark, min_docs
        self.levels: list[list[str]] = []

    def _write(self, entries: DataFrame) -> str:
        path = new_folder(self.spark, "run")
        entries.repartition("key").sortWithinPartitions("key").write.parquet(path)
        return path

    def entries(self) -> DataFrame:
        """All entries, merged over the runs."""
        paths = [path for level in self.levels for path in level]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self._merged(paths)

    def _merged(self, paths: list[str]) -> DataFrame:
        rows = self.spark.read.schema(self.schema).parquet(*paths)
        return rows.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("top").alias("top"))

    def repeated(self) -> DataFrame:
        """(key, top) of the keys found in enough documents."""
        return self.entries().where(F.col("n_docs") >= self.min_docs).select("key", "top")

    def add(self, lines: DataFrame) -> None:
        """Take in a batch of (id, key); no document may come in two batches.

        The batch is anti-joined with the runs: a key that was found often enough already, in a
        larger document than any of the batch, needs no entry. The rest becomes a run.
        """
        own = lines.groupBy("key").agg(F.count_distinct("id").alias("n_docs"), F.max("id").alias("top"))
        if self.levels:
            known = self.repeated().withColumnRenamed("top", "known_top").withColumnRenamed("key", "known")
            own = own.join(known, (F.col("key") == F.col("known")) & (F.col("known_top") >= F.col("top")), "left_anti")
        self._place(self._write(own), 0)

    def _place(self, path: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)
        if len(self.levels[level]) == FANOUT:
            merged = self._write(self._merged(self.levels[level]))
            self.levels[level] = []
            self._place(merged, level + 1)


def _keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = {line_key(line, min_chars) for line in (text or "").split("\n")} - {None}
                ids.extend([doc] * len(found))
                keys.extend(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["id", "key"])

    return run


def _without(min_chars: int):
    def run(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
        out, lines_in, lost = [], [], []
        for text, keys in zip(texts, gone):
            lines = (text or "").split("\n")
            if keys is None or not len(keys):
                kept, new = lines, text or ""
            else:
                drop = set(map(bytes, keys))
                kept = [line for line in lines if line_key(line, min_chars) not in drop]
                new = "\n".join(kept)
            out.append(new)
            lines_in.append(len(lines))
            lost.append(len(lines) - len(kept))
        return pd.DataFrame({"text": out, "n_lines": lines_in, "n_dropped": lost})

    return run


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3
) -> DataFrame:
    """The rows of ``docs`` with the shortened text, and the column ``line_dedup`` (n_lines, n_dropped).

    A key of at least ``min_chars`` characters that ``min_docs`` documents hold is kept in the largest id
    only; all its lines in other documents go. Null and empty texts are one empty line, and a null
    text becomes empty. Rows of one id count as one document and lose the same keys. Rows
    with a null id neither count nor lose lines. Other columns pass through unchanged.
    """
    spark = ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    lines = rows.where("id IS NOT NULL").mapInArrow(_keys(min_chars), "id long, key binary")
    path = new_folder(spark, "lines")
    lines.withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(BATCHES)).cast("int")).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema("id long, key binary, batch int").parquet(path)

    runs = LineRuns(spark, min_docs)
    for batch in range(BATCHES):
        runs.add(lines.where(F.col("batch") == batch).select("id", "key"))
    repeated = cut(runs.repeated())
    lost = lines.join(repeated, "key").where("id < top").select("id", "key").distinct()
    lost = cut(lost.groupBy(F.col("id").alias("__id")).agg(F.collect_list("key").alias("__gone")))

    shorten = F.pandas_udf(_without(min_chars), "text string, n_lines long, n_dropped long")
    joined = docs.join(lost, docs[id_col].cast("long") == F.col("__id"), "left").withColumn(
        "__new", shorten(docs[text_col].cast("string"), F.col("__gone"))
    )
    kept = [F.col("__new.text").alias(c) if c == text_col else docs[c] for c in docs.columns if c != "line_dedup"]
    return joined.select(*kept, F.struct("__new.n_lines", "__new.n_dropped").alias("line_dedup"))
