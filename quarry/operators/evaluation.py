"""Evaluation results in long form: (question, baseline, criterion, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clamped(score: Column) -> Column:
    """Scores of a judge, 1 to 5."""
    return F.greatest(F.lit(1), F.least(F.lit(5), score))


def averages(scores: DataFrame) -> DataFrame:
    """Total and average, of two digits, of each answer."""
    return scores.groupBy("question", "baseline").agg(F.sum("score").cast("long").alias("total"), F.round(F.avg("score"), 2).alias("average"))


def summary(scores: DataFrame, own: str) -> DataFrame:
    """Mean of averages by baseline, and our advantage over each: our mean over all our questions less theirs, both of two digits."""
    means = averages(scores).groupBy("baseline").agg(F.count("*").alias("questions"), F.round(F.avg("average"), 2).alias("_m"))
    ours = means.where(F.col("baseline") == own).select(F.col("_m").alias("_own"))  # one row
    return means.crossJoin(F.broadcast(ours)).select("baseline", "questions", F.col("_m").alias("mean"), F.round(F.col("_own") - F.col("_m"), 2).alias("advantage"))


def compared(scores: DataFrame, own: str) -> DataFrame:
    """Each question's average of every baseline that it has, and our advantage over it."""
    a = averages(scores)
    ours = a.where(F.col("baseline") == own).select("question", F.col("average").alias("_own"))
    return a.join(ours, "question", "left").select("question", "baseline", "average", F.round(F.col("_own") - F.col("average"), 2).alias("advantage"))


def criterion_means(scores: DataFrame) -> DataFrame:
    return scores.groupBy("baseline", "criterion").agg(F.round(F.avg("score"), 2).alias("mean"))


def wins(scores: DataFrame, own: str) -> DataFrame:
    """Wins, losses and ties against each baseline, over the questions that it has."""
    a = averages(scores)
    ours = a.where(F.col("baseline") == own).select("question", F.col("average").alias("_own"))
    d = F.col("_own") - F.col("average")
    return a.where(F.col("baseline") != own).join(ours, "question").groupBy("baseline").agg(F.count_if(d > 0).alias("wins"), F.count_if(d < 0).alias("losses"), F.count_if(d == 0).alias("ties"))


def bands(scores: DataFrame, own: str) -> DataFrame:
    """Answers by band: OK from 4, WEAK from 3, else FAIL; and those of 4.5 or more."""
    a = averages(scores).where(F.col("baseline") == own)
    band = F.when(F.col("average") >= 4, "OK").when(F.col("average") >= 3, "WEAK").otherwise("FAIL")
    return a.groupBy(band.alias("band")).agg(F.count("*").alias("cnt"), F.count_if(F.col("average") >= 4.5).alias("excellent"))


def diagnosis(hits: DataFrame, expected: str, source: str, year: str | None = None) -> DataFrame:
    """By question: hits of the expected source and their share, how many sources there are and the share of
    the most frequent one, mean score, drop-off of scores, spread of years, severity of the miss rate."""
    correct = F.count_if(F.col(source) == F.col(expected))
    rate = F.lit(100.0) * (F.count("*") - correct) / F.count("*")
    severity = F.when(rate < 25, "LOW").when(rate < 50, "MEDIUM").otherwise("HIGH")
    of = Window.partitionBy("question", source)
    rows = hits.withColumn("_same", F.count("*").over(of))
    more = [F.count_distinct(source).alias("sources"), F.round(F.lit(100.0) * F.max("_same") / F.count("*"), 1).alias("main_share"), F.round(F.avg("score"), 4).alias("context_score")]
    more += [(F.max(year) - F.min(year)).alias("year_spread")] if year else []
    return rows.groupBy("question").agg(F.count("*").alias("hits"), correct.alias("correct"), F.round(F.lit(100.0) * correct / F.count("*"), 1).alias("correct_pct"), F.round(rate, 1).alias("issue_rate"), F.round(F.max("score") - F.min("score"), 6).alias("drop_off"), severity.alias("severity"), *more)


def last_turns(turns: DataFrame, n: int = 10) -> DataFrame:
    """The last n turns of each conversation."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"), F.desc("text"))
    return turns.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")


def breaker(events: DataFrame, key: str, order: str, failed: Column, limit: int) -> DataFrame:
    """Rows up to the one at which ``limit`` consecutive failures are reached, by key."""
    w = Window.partitionBy(key).orderBy(order)
    run = events.withColumn("_ok", F.sum(F.when(failed, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    island = Window.partitionBy(key, "_ok").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    run = run.withColumn("streak", F.sum(F.when(failed, 1).otherwise(0)).over(island).cast("int"))
    tripped = F.coalesce(F.max((F.col("streak") >= limit).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return run.withColumn("_stop", tripped).where("_stop = 0").drop("_ok", "_stop")
