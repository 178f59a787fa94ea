"""Streams: progress counts over arriving events, and incremental loads of new records."""

from __future__ import annotations

import json
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def folder(spark: SparkSession) -> str:
    """Where streams keep their state: the shared folder of the session, or a local one without it."""
    return f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only in a local session, where it is unset."""
    if not (base := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """The frame as Parquet in the shared folder, read back; cuts its lineage."""
    path = f"{shared_folder(df.sparkSession)}/quarry/{uuid.uuid4().hex}/rows"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def written_and_observed(df: DataFrame, **facts: Column) -> tuple[DataFrame, dict]:
    """The written frame and aggregates of its rows, taken while they are written."""
    if not facts:
        return written(df), {}
    seen = Observation()
    return written(df.observe(seen, *(c.alias(name) for name, c in facts.items()))), seen.get


def discard(*tables: DataFrame) -> None:
    """Delete tables made by written() that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def progress(spark: SparkSession, path: str, glob: str, schema: StructType, by: str) -> DataFrame:
    """Events by kind (cnt), and the running total in order of kinds (total), as a stream over the files
    there now would report at its end."""
    name = f"progress_{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").parquet(path)
    query = stream.groupBy(by).agg(F.count("*").alias("cnt")).writeStream.outputMode("complete").format("memory").queryName(name)
    query.option("checkpointLocation", folder(spark)).trigger(availableNow=True).start().awaitTermination()
    running = F.sum("cnt").over(Window.orderBy(by))  # a row for each kind
    return spark.table(name).withColumn("total", running)


def events(counts: DataFrame, by: str) -> Iterator[str]:
    """Server-sent events of progress: one for each kind with the total so far, then the end."""
    total = 0
    for row in counts.orderBy("total", by).collect():  # a row for each source
        total = row["total"]
        yield f"data: {json.dumps({'type': 'source_complete', 'data': {'source': row[by], 'record_count': row['cnt'], 'total_records': total}})}\n\n"
    yield f"data: {json.dumps({'type': 'complete', 'data': {'record_count': total}})}\n\n"


def polled(records: Callable[[], DataFrame], done: Callable[[], DataFrame], key: str, work: Callable[[DataFrame], DataFrame], save: Callable[[DataFrame], None], batch: int = 10, rounds: int = 1, wait: float = 21_600.0, sleep: Callable[[float], None] = time.sleep) -> int:
    """A worker that takes up to ``batch`` records without a result in each round, and waits between rounds.

    records, done: read anew each time; save must be idempotent by key.  A round that fails is left, and
    its records come again.  Returns the number of records saved.
    """
    total = 0
    for i in range(rounds):
        some = records().join(done().select(key), key, "left_anti").orderBy(key).limit(batch)
        try:
            found = work(some)
            save(found)
            total += found.count()
        except Exception as e:  # noqa: BLE001  the next round tries again
            print(f"round {i + 1} failed: {e}")
        if i + 1 < rounds:
            sleep(wait)
    return total


def load_new(stream: DataFrame, target: str, key: str, transform=lambda df: df) -> None:
    """Append the records of a stream whose key is not in the target yet (Parquet), batch by batch.

    A batch that is run again adds nothing, since its keys are there.
    """
    spark = stream.sparkSession

    def append(batch: DataFrame, _epoch: int) -> None:
        new = batch.dropDuplicates([key])
        try:
            new = new.join(spark.read.parquet(target).select(key), key, "left_anti")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
        transform(new).write.mode("append").parquet(target)

    stream.writeStream.foreachBatch(append).option("checkpointLocation", folder(spark)).trigger(availableNow=True).start().awaitTermination()
