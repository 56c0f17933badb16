"""Session settings and the shared folder that loops and written tables use."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: str | int = "*", partitions: int = 8, name: str = "flowsieve") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package's code to the Python workers (once a session), one thread for each."""
    sc = spark.sparkContext
    if getattr(sc, "_flowsieve_shipped", None) is None:
        root = os.path.dirname(os.path.abspath(__file__))
        target = os.path.join(tempfile.mkdtemp(prefix="flowsieve-code-"), "flowsieve.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        archive.write(full, os.path.relpath(full, os.path.dirname(root)))
        sc.addPyFile(target)
        sc._flowsieve_shipped = target
        # a task has one core, and small products wait longer for a second thread than they save by it
        sc.environment.setdefault("OMP_NUM_THREADS", "1")


def shared_dir(spark: SparkSession) -> str:
    """Folder of ``spark.checkpoint.dir``; a temporary one only in local mode."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="flowsieve-"))
        current = sc.getCheckpointDir()
    return current


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Rows of numbers and repeated names are this many times larger in memory than in Parquet files.
IN_MEMORY = "50"


@contextmanager
def sizes_in_memory(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark takes a file for what its rows need in memory, unless the session has its own factor.

    Broadcast thresholds are meant for rows; taken by the size of compressed files, a table of 10 MB is sent through
    the driver as half a GB of rows. Shuffles are measured in rows anyway, so what is small is still broadcast; a loop does
    that in every round, so its tables count as small below 2 MB. More is shuffled instead, so this is for work
    whose many joins would fill the driver. It holds for plans that run inside: ``cut`` what is returned.
    """
    factor, small = "spark.sql.sources.fileCompressionFactor", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = {name: spark.conf.get(name, None) for name in (factor, small)}
    if float(before[factor] or 1) == 1:
        spark.conf.set(factor, IN_MEMORY)
    if before[small] is None:
        spark.conf.set(small, "2m")
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from the written table.

    The lineage ends here, a lost executor costs only a re-read, and Spark knows
    the true size of the table, so it broadcasts it only below its own threshold.
    """
    spark = df.sparkSession
    path = new_folder(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_counted(df: DataFrame, condition: Column | None = None) -> tuple[DataFrame, int]:
    """``cut`` plus the number of rows (that meet the condition), counted while they are written."""
    seen = Observation()
    counted = F.count(F.lit(1)) if condition is None else F.count_if(condition)
    table = cut(df.observe(seen, counted.alias("rows")))
    return table, seen.get["rows"]
