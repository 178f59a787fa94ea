"""Samples by hash: the same rows as an order over all, few rows on their way to the driver."""

from pyspark.sql import functions as F

from quarry.functions.samples import least_hashed


def test_a_sample_is_the_least_hashes_and_bounded_before_the_limit(spark):
    rows = spark.range(0, 200_000, 1, 40).withColumnRenamed("id", "node")
    want = [r[0] for r in rows.orderBy(F.xxhash64("node"), "node").limit(500).collect()]
    got = least_hashed(rows, ["node"], 500, 200_000)
    assert [r[0] for r in got.collect()] == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan  # what follows is about the rows that pass it
    low = rows.where(F.xxhash64("node") < F.lit(-(1 << 63) + (1 << 64) * 1000 // 200_000)).count()
    assert 500 <= low <= 2000


def test_a_small_table_is_taken_whole(spark):
    rows = spark.range(300).withColumnRenamed("id", "node")
    assert least_hashed(rows, ["node"], 500, 300).count() == 300
