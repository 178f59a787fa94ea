"""Shared pieces of the llm operators: tables between steps, connected components, Arrow helpers."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.batches import small_batches

#: Lets Spark drop a finished query's shuffle files at once, not when the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share.

    Only where the setting is absent (a local session, as in tests) a temporary folder is used.
    """
    if not (folder := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as Parquet in the shared folder and read it back.

    It cuts the lineage: an executor lost later costs no recomputation of what came before, and the
    shuffle files of the query that made it are dropped when it is complete.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_folder(spark)}/quarry/{uuid.uuid4().hex}/{name}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables made by materialize() that nothing reads any more."""
    for df in frames:
        with contextlib.suppress(Exception):  # files that are already gone
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_to)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    links: (a, b) longs, any direction, repeats allowed.  Returns (node, component): the smallest
    node reachable, for every node with a link to another.  Each step is a grouped minimum and a
    join on the node, so a hub's edges are pre-aggregated or split among tasks; the rounds grow with
    the logarithm of the longest path.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges, "edges")
    state = None
    for _ in range(rounds):
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == state or now["n"] == 0:
            break
        state = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("x"), "m"), F.struct(F.col("a").alias("x"), "m"))).alias("e"))
        new = materialize(small.select(F.col("e.x").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct(), "edges")
        discard(edges)
        edges = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def by_column(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of the test data."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
