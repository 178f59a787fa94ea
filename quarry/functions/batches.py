"""How many rows a Python worker gets at once, and how much a task of a shuffle."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows of an Arrow batch: long texts make even these a few MB, which is held several times over.
BATCH_ROWS = 512
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS, where the session has Spark's default of 10,000."""
    if spark.conf.get(_ROWS) == "10000":
        spark.conf.set(_ROWS, str(BATCH_ROWS))


#: Bytes of a shuffle that one task reads, compressed: narrow rows take ten times that when they are sorted.
PART_BYTES = 16 << 20
_PART = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def small_partitions(spark: SparkSession) -> None:
    """Partitions of PART_BYTES after a shuffle, where the session has Spark's default of 64 MB."""
    if spark.conf.get(_PART) in ("64MB", "64m", "67108864", "67108864b"):
        spark.conf.set(_PART, str(PART_BYTES))
