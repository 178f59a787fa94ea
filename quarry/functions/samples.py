"""Bounded samples of tables, taken by hashes, so that a repetition takes the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def least_hashed(rows: DataFrame, keys: list[str], most: int, count: int) -> DataFrame:
    """The ``most`` rows (of ``count``) with the least hashes of their keys, ties by the first key.

    Rows that by their hash cannot be among these, save with the chance of a hash that is not uniform, are
    left out before the limit: without that every task would send ``most`` rows to the driver.
    """
    h = F.xxhash64(*keys)
    if count > 4 * most:
        rows = rows.where(h < F.lit(-(1 << 63) + (1 << 64) * 2 * most // count))  # twice as many as are wanted
    return rows.orderBy(h, keys[0]).limit(most)
