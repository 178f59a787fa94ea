"""Sinks: files, tables that are made when they are missing, and idempotent writers of batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import records as R


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object a line; nulls are left out."""
    rows.write.mode("overwrite").json(path)


def write_csv(path: str, *tables: DataFrame) -> None:
    """Tables under one header (see records.csv_rows), with a header in each file."""
    R.csv_rows(*tables).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def ensure_table(spark: SparkSession, name: str, fields: str, partition_by: str | None = None, sort_by: str | None = None, buckets: int = 16) -> None:
    """A Parquet table, if it is not there yet.

    An index on a column has no counterpart: a column that is filtered by may be its partitions, one that
    is joined by its buckets, which are sorted.
    """
    part = f" partitioned by ({partition_by})" if partition_by else ""
    clustered = f" clustered by ({sort_by}) sorted by ({sort_by}) into {buckets} buckets" if sort_by else ""
    spark.sql(f"create table if not exists {name} ({fields}) using parquet{part}{clustered}")


def upsert_vectors(stored: DataFrame | None, chunks: DataFrame, order: str) -> DataFrame:
    """Points (id, vector, payload) after a batch: the id is drawn from the chunk's, the last write wins."""
    points = chunks.withColumn("id", T.point_id(F.col("chunk_id")))
    new = R.last_wins(points, ["id"], F.col(order)).drop(order)
    return new if stored is None else stored.join(new.select("id"), "id", "left_anti").unionByName(new)


def merge_edges(stored: DataFrame | None, new: DataFrame) -> DataFrame:
    """Edges (src, dst) after a batch, each once; ends that are null or empty are dropped."""
    fine = new.where("coalesce(cast(src as string), '') <> '' and coalesce(cast(dst as string), '') <> ''").select("src", "dst")
    return (fine if stored is None else stored.unionByName(fine)).distinct()


def merge_nodes(stored: DataFrame | None, new: DataFrame, key: str, order: str) -> DataFrame:
    """Nodes after a batch: the last properties of each key."""
    rows = R.last_wins(new, [key], F.col(order)).drop(order)
    return rows if stored is None else stored.join(rows.select(key), key, "left_anti").unionByName(rows)


def into_store(stream: DataFrame, key: str, write: Callable[[list[dict]], None], checkpoint: str, size: int = 500) -> None:
    """Upsert a stream's records into a document store, some at a time, from the tasks.

    write: replaces the records of the keys that it gets, so a batch that is run again changes nothing.
    Of a key that a batch repeats one record is written.
    """

    def put(rows) -> None:
        held: list[dict] = []
        for row in rows:
            held.append(row.asDict(recursive=True))
            if len(held) == size:
                write(held)
                held = []
        if held:
            write(held)

    query = stream.writeStream.foreachBatch(lambda batch, _epoch: batch.dropDuplicates([key]).foreachPartition(put))
    query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def report(summary: DataFrame, columns: list[str], title: str) -> str:
    """A table of a few rows as text, for a terminal."""
    rows = [columns, *([str(r[c]) for c in columns] for r in summary.select(columns).collect())]
    width = [max(len(r[i]) for r in rows) for i in range(len(columns))]
    line = lambda r: "  ".join(v.ljust(w) for v, w in zip(r, width, strict=True)).rstrip()
    return "\n".join([title, "=" * len(title), line(rows[0]), "  ".join("-" * w for w in width), *map(line, rows[1:])])
