"""Data-quality audits of a record table: one aggregation each, pre-aggregated before the shuffle.

Empty text counts as missing, like null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | (c == "")


def percent(part: Column, whole: Column) -> Column:
    return F.round(F.lit(100.0) * part / F.nullif(whole, F.lit(0)), 1)


def coverage(records: DataFrame, by: str, content: str) -> DataFrame:
    """Records with and without content, and their share, by crawler."""
    total, have = F.count("*"), F.count_if(~missing(content))
    return records.groupBy(by).agg(total.alias("total"), have.alias("with_content"), (total - have).alias("empty_content"), percent(have, total).alias("pct"))


def truncation(records: DataFrame, by: str, length: Column, cuts: tuple[int, ...], near: int = 10) -> DataFrame:
    """Records whose length is exactly at, or near, a cut, where there are any."""
    out = [F.count_if(length == c).alias(f"exact_{c}") for c in cuts] + [F.count_if(length.between(c - near, c + near)).alias(f"near_{c}") for c in cuts]
    found = records.groupBy(by).agg(*out)
    return found.where(" or ".join(f"near_{c} > 0" for c in cuts))


def attachment_gaps(records: DataFrame, by: str, attachments: Column, content: Column) -> DataFrame:
    """Records with attachments, and those of them without content."""
    have = attachments
    return records.groupBy(by).agg(F.count_if(have).alias("with_attachment"), F.count_if(have & ~F.coalesce(content, F.lit(False))).alias("gap")).where("gap > 0")


def dead_letters(failures: DataFrame, *by: str) -> DataFrame:
    """Unresolved failures by the given keys."""
    return failures.groupBy(*by).agg(F.count("*").alias("cnt"))


def cache_completeness(records: DataFrame, cache: DataFrame, key: str, by: str) -> DataFrame:
    """Documents, those with a cached copy, and those missing, by crawler; fan-out is counted once."""
    joined = records.select(by, key).join(cache.select(F.col(key), F.lit(1).alias("hit")), key, "left")
    out = joined.groupBy(by).agg(F.count_distinct(F.col(key)).alias("docs"), F.count_distinct(F.when(F.col("hit").isNotNull(), F.col(key))).alias("cached"))
    return out.withColumn("missing", F.col("docs") - F.col("cached"))


def distribution(records: DataFrame, by: str, kind: Column) -> DataFrame:
    return records.groupBy(F.col(by), kind.alias("method")).agg(F.count("*").alias("cnt"))


def short_content(records: DataFrame, by: str, length: Column, limit: int = 500) -> DataFrame:
    """Number, least and rounded mean length of short non-empty records."""
    short = records.withColumn("_n", length).where((F.col("_n") > 0) & (F.col("_n") < limit))
    return short.groupBy(by).agg(F.count("*").alias("cnt"), F.min("_n").alias("shortest"), F.round(F.avg("_n")).cast("int").alias("mean_length"))
