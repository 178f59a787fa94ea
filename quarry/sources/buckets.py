"""Parquet tables cut into numbered buckets, of which a merge rewrites only those that it touches.

A table is a folder with a partition for each bucket.  A merge first writes the new rows of its buckets
beside them, then lets these replace the old ones, then leaves a mark that it is done.  A merge that was
broken off after the first step is finished before the next one; one that is repeated changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column of the bucket's number.
BUCKET = "bucket"


def bucket_of(key: Column, buckets: int) -> Column:
    """The bucket of a key; of a literal it is a constant that prunes partitions."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class Table:
    """One such table: its folder and the columns of its rows, the bucket's number last."""

    def __init__(self, spark: SparkSession, path: str, schema: str, sort_by: list[str], files: int = 1):
        """files: how many files a bucket's rows may be dealt to, so that a hot bucket is no single task."""
        self.spark, self.path, self.schema, self.sort_by, self.files = spark, path.rstrip("/"), f"{schema}, {BUCKET} int", sort_by, files

    def _files(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path + name)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _exists(self, name: str = "") -> bool:
        fs, path = self._files(name)
        return fs.exists(path)

    def _delete(self, name: str) -> None:
        fs, path = self._files(name)
        fs.delete(path, True)

    def read(self) -> DataFrame:
        """All rows; no rows before the first write."""
        if not self._exists():
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def _written(self, rows: DataFrame, path: str, mode: str, dealt_already: bool = False) -> None:
        """In the table's own folder the written buckets replace the old ones; elsewhere a folder is written
        whole, and has Spark's mark of success only then."""
        dealt = rows.select(*(f.split()[0] for f in self.schema.split(", ")))
        salt = F.pmod(F.xxhash64(*self.sort_by, F.lit("salt")), F.lit(self.files))
        if not dealt_already:
            dealt = dealt.repartition(BUCKET, salt) if self.files > 1 else dealt.repartition(BUCKET)
        replace = "dynamic" if path == self.path else "static"
        dealt.sortWithinPartitions(BUCKET, *self.sort_by).write.mode(mode).option("partitionOverwriteMode", replace).partitionBy(BUCKET).parquet(path)

    def append(self, rows: DataFrame, dealt: bool = False) -> None:
        """More files for the buckets of these rows, which have the bucket's number.

        dealt: the rows of a bucket lie in few tasks already.
        """
        self._written(rows, self.path, "append", dealt)

    def merge(self, name: str, batch: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame], also: list[int] | None = None) -> list[int]:
        """Replace the touched buckets by change(their rows, batch); returns their numbers.

        batch has the bucket's number; what ``change`` returns must lie in the batch's buckets or those of
        ``also``.  name: of this batch, by which a repetition is known.
        """
        self.recover()
        if self._exists(f"/_done/{name}"):
            return []
        touched = sorted({r[0] for r in batch.select(BUCKET).distinct().collect()} | set(also or []))  # as many as there are buckets at most
        if touched:
            new = change(self.read().where(F.col(BUCKET).isin(touched)), batch)
            self.spark.createDataFrame([(b,) for b in touched], f"{BUCKET} int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/_touched/{name}")
            self._written(new, f"{self.path}/_staged/{name}", "overwrite")
        self._finish(name)
        return touched

    def recover(self) -> None:
        """Finish merges whose new rows were written whole."""
        fs, path = self._files("/_staged")
        for found in fs.listStatus(path) if fs.exists(path) else []:
            name = found.getPath().getName()
            if self._exists(f"/_staged/{name}/_SUCCESS") and not self._exists(f"/_done/{name}"):
                self._finish(name)
            else:
                self._delete(f"/_staged/{name}")

    def _finish(self, name: str) -> None:
        staged, touched = f"/_staged/{name}", f"/_touched/{name}"
        if self._exists(staged):
            rows = self.spark.read.schema(self.schema).parquet(self.path + staged)
            self._written(rows, self.path, "overwrite")
            for (b,) in self.spark.read.parquet(self.path + touched).collect():
                if not self._exists(f"{staged}/{BUCKET}={b}"):  # it has no rows any more
                    self._delete(f"/{BUCKET}={b}")
        fs, mark = self._files(f"/_done/{name}")
        fs.create(mark, True).close()
        self._delete(staged)
        self._delete(touched)


def save_links(rows: DataFrame, name: str, path: str, key: str = "link", buckets: int = 16) -> None:
    """Add the keys of rows to a table of them, which is bucketed and sorted by key."""
    keys = rows.where(F.col(key).isNotNull()).select(key).distinct().repartition(buckets, key)
    keys.write.mode("append").format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def not_saved(batch: DataFrame, name: str, key: str = "link", buckets: int = 16) -> DataFrame:
    """Rows of a batch whose key the table does not hold, or that have none.

    Only the batch is shuffled, to the table's buckets; rows without a key do not take part in that.
    """
    dealt = batch.where(F.col(key).isNotNull()).repartition(buckets, key)
    new = dealt.join(batch.sparkSession.table(name).select(key).hint("merge"), key, "left_anti")
    return new.select(batch.columns).unionByName(batch.where(F.col(key).isNull()))
