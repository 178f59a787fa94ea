"""A training-corpus pipeline: five stages, each written as Parquet and read again by the next.

Every stage works on all documents that the one before kept; all but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontamination, lines, minhash, packing, quality
from quarry.llm.common import by_column, materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> DataFrame:
    """The columns of documents; n_chars counts what is left of the text."""
    return docs.selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as long) as n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives a probability of quality of THRESHOLD or more."""
    model = quality.fit(docs, by_column(spark, sf_dir, "labels"))
    return _columns(quality.score(docs, *model).where(f"score >= {quality.THRESHOLD}"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; one that consists of such lines stays, with what is left of it."""
    return _columns(lines.drop_recurring(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the least id, of those that share it the
    one of the least text hash.

    Decided by texts, not by ids: different texts under one id are documents of their own, and a text
    without an id stays if no other is like it.  Rows without an id stand behind all that have one.  Of
    texts without words, which are like nothing, those equal in id and text are one.
    """
    rows = docs.withColumn("_h", F.xxhash64("text"))
    first = rows.groupBy("_h").agg(F.min("doc_id").alias("_i"), F.first("text").alias("text"))  # equal texts are one
    first = materialize(first, "texts")
    group = minhash.near_duplicates(first.select("_h", "text"), id_col="_h").where("n_shingles > 0").selectExpr("doc_id as _h", "component_id as _c")
    best = F.min(F.struct(F.col("_i").isNull().alias("none"), "_i", "_h")).alias("b")
    kept = first.select("_h", "_i").join(group, "_h").groupBy("_c").agg(best).selectExpr("b._h as _k", "b._i as _i")
    blank = rows.where(r"not rlike(coalesce(text, ''), '[^\\x20\\x09-\\x0D]')").selectExpr("_h as _k", "doc_id as _i").distinct()
    kept = materialize(kept.unionByName(blank), "kept").hint("merge")
    out = rows.join(kept, F.expr("_h = _k and doc_id <=> _i"), "left_semi")
    return _columns(out.dropDuplicates(["_h", "doc_id"]))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return _columns(decontamination.leaks(docs, by_column(spark, sf_dir, "benchmark")).where("size(leaks) = 0"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents, packed into sequences."""
    return packing.pack_documents(docs)


STAGES = [("quality", keep_quality), ("lines", drop_lines), ("near_duplicates", drop_copies), ("decontamination", drop_leaks), ("packing", pack)]

#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = by_column(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
