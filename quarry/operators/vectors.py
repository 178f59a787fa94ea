"""Exact vector search over clustered files.

Vectors are written by the nearest of a bounded number of centroids, with their norms and their distance
from the centroid (of unit vectors).  By the triangle inequality a cluster's radius bounds the cosine of
every vector in it, so a search reads the most promising clusters first and then only those that can
still hold a better vector; within them only rows whose distance from the centroid allows it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.samples import least_hashed
from quarry.operators.retrieval import best
from quarry.sources.buckets import BUCKET, Table

#: Vectors that the centroids are fitted on, and steps of the fit: bounds.  They decide about speed only.
SAMPLE, STEPS = 4096, 8
#: Cluster of vectors whose norm is 0.
ZERO = -1


def _dot(vector: Column, query: list[float]) -> Column:
    pairs = F.zip_with(F.transform(vector, lambda x: x.cast("double")), F.array(*(F.lit(float(x)) for x in query)), lambda a, b: a * b)
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def _norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(vector, lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x * x))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def centroids(vectors: DataFrame, clusters: int) -> np.ndarray:
    """Unit centroids by k-means over a sample drawn by hash."""
    some = vectors.where("embedding is not null")
    rows = least_hashed(some, ["id"], SAMPLE, some.count()).select("embedding").collect()
    x = _unit(np.array([r[0] for r in rows], dtype=np.float64))
    centres = x[np.linspace(0, len(x) - 1, min(clusters, len(x))).astype(int)]
    for _ in range(STEPS):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        held = np.bincount(near, minlength=len(centres))[:, None] > 0
        centres = np.where(held, _unit(sums), centres)
    return centres


class VectorIndex:
    """Points (id, embedding, payload columns) by cluster.  payload: their fields as DDL."""

    def __init__(self, spark: SparkSession, path: str, payload: str, clusters: int = 64):
        self.spark, self.path, self.clusters = spark, path, clusters
        self.points = Table(spark, f"{path}/points", f"id long, embedding array<float>, {payload}, norm double, gap double", ["gap", "id"])
        self.payload = [f.split()[0] for f in payload.split(", ")]

    def _centres(self) -> np.ndarray:
        rows = self.spark.read.parquet(f"{self.path}/centroids").orderBy("cluster").collect()  # as many as clusters
        return np.array([r["centroid"] for r in rows])

    def _assigned(self, points: DataFrame, centres: np.ndarray) -> DataFrame:
        """Points with norm, gap and cluster; points without a vector are left out, as no search finds them."""

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.array(batch.column("embedding").to_pylist(), dtype=np.float64).reshape(batch.num_rows, -1)
                u = _unit(x)
                cluster = (u @ centres.T).argmax(axis=1) if batch.num_rows else np.zeros(0, dtype=np.int64)
                gap = np.linalg.norm(u - centres[cluster], axis=1)
                cluster = np.where(np.abs(x).sum(axis=1) > 0, cluster, ZERO)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(gap), pa.array(cluster.astype(np.int32))], schema=batch.schema.append(pa.field("gap", pa.float64())).append(pa.field(BUCKET, pa.int32())))

        rows = points.where("embedding is not null").select("id", "embedding", *self.payload).withColumn("embedding", F.col("embedding").cast("array<float>")).withColumn("norm", _norm(F.col("embedding")))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        return rows.mapInArrow(near, f"{schema}, gap double, {BUCKET} int")

    def build(self, points: DataFrame) -> None:
        """Fit the centroids and write all points."""
        rows = [(i, c.tolist()) for i, c in enumerate(centroids(points, self.clusters))]
        self.spark.createDataFrame(rows, "cluster int, centroid array<double>").coalesce(1).write.parquet(f"{self.path}/centroids")
        self.points.append(self._assigned(points, self._centres()))
        self._measure(0, None)

    def upsert(self, points: DataFrame, version: int) -> list[int]:
        """Points in place of those of the same ids; returns the clusters that were rewritten.

        version: of this batch, from 1 on; one that is repeated changes nothing.
        """
        new = self._assigned(points, self._centres())
        ids = points.select("id").distinct()
        old = [r[0] for r in self.points.read().select("id", BUCKET).join(ids, "id", "left_semi").select(BUCKET).distinct().collect()]  # clusters
        touched = self.points.merge(str(version), new, lambda stored, batch: stored.join(ids, "id", "left_anti").unionByName(batch), old)
        if touched:
            self._measure(version, touched)
        return touched

    def _measure(self, version: int, touched: list[int] | None) -> None:
        """Number and radius of each cluster, as a new table that the next search reads."""
        rows = self.points.read() if touched is None else self.points.read().where(F.col(BUCKET).isin(touched))
        found = rows.groupBy(BUCKET).agg(F.count("*").alias("n"), F.max("gap").alias("radius"))
        if touched is not None:
            found = found.unionByName(self.spark.read.parquet(self._sizes()).where(~F.col(BUCKET).isin(touched)))
        found.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/sizes/{version:012d}")

    def _sizes(self) -> str:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/sizes")
        names = [f.getPath().getName() for f in path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)]
        return f"{self.path}/sizes/{max(names)}"

    def search(self, query: list[float], k: int = 12, threshold: float = 0.35, where: Column | None = None) -> DataFrame:
        """The k best points at or above the threshold, as retrieval.search finds them among all.

        Two reads: the clusters that promise most, up to four times k points, then those that are left.
        The frame has the clusters it reads in ``clusters_read``.
        """
        norm = float(sum(float(x) * float(x) for x in query) ** 0.5)
        q = np.array(query, dtype=np.float64) / max(norm, 1e-300)
        away = np.linalg.norm(self._centres() - q, axis=1)
        sizes = self.spark.read.parquet(self._sizes()).collect()  # a row for each cluster
        most = {r[BUCKET]: 0.0 if r[BUCKET] == ZERO or not norm else 1 - max(0.0, away[r[BUCKET]] - r["radius"]) ** 2 / 2 for r in sizes}
        size = {r[BUCKET]: r["n"] for r in sizes}
        order, first, held = sorted(most, key=lambda c: (-most[c], c)), [], 0
        for c in order:
            if held >= 4 * k:
                break
            first.append(c)
            held += size[c]

        def scored(clusters: list[int], reach: float | None) -> DataFrame:
            rows = self.points.read().where(F.col(BUCKET).isin(clusters))
            if reach is not None:  # rows whose distance from the centroid rules them out, told by the files' statistics
                near = [(F.col(BUCKET) == c) & ((F.lit(c) == ZERO) | F.col("gap").between(float(away[c]) - reach, float(away[c]) + reach)) for c in clusters]
                within = near[0]
                for n in near[1:]:
                    within = within | n
                rows = rows.where(within)
            rows = rows if where is None else rows.where(where)
            score = F.when(F.col("norm") * norm == 0, F.lit(0.0)).otherwise(_dot(F.col("embedding"), query) / (F.col("norm") * norm))
            return rows.withColumn("score", F.round(score, 6)).select("id", *self.payload, "score").where(F.col("score") >= threshold)

        top = best(scored(first, None), k)
        scores = [r["score"] for r in top.select("score").collect()]  # k at most
        least = max(threshold, min(scores)) if len(scores) == k else threshold
        rest = [c for c in order if c not in first and most[c] >= least - 1e-6]
        out = top if not rest else best(top.unionByName(scored(rest, math.sqrt(max(0.0, 2 - 2 * least)) + 2e-3)), k)
        out.clusters_read = sorted(first + rest)
        return out
