"""What every operator needs from the session: code on the workers, bounded Arrow batches.

Batches are a setting of the session: it holds for later Python functions of the same session as well.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from flowsieve.session import ship

#: Rows of one Arrow batch; texts may be long, so a batch holds few of them.
BATCH_ROWS = 512
#: Bytes of one batch, so that 512 very long texts are several.
BATCH_BYTES = 256 << 20


def ready(spark: SparkSession) -> SparkSession:
    """Send this package's code to the Python workers (once a session), one thread for each, and bound the Arrow batches."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark
