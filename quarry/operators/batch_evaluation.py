"""Evaluation of many questions end to end: hits, own answers, answers of baselines, a judge, results.

Questions are a table throughout, and every model is asked within tasks, once for each row (again only where a task is
repeated): what it said is written before it is used twice.  A model that fails leaves its error in its own row and ends nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import fixed_values as V
from quarry.functions import text as T
from quarry.functions.batches import small_batches
from quarry.functions.providers import TextModel
from quarry.operators import answers as AN
from quarry.operators import retrieval as S
from quarry.streaming.progress import discard, written

OWN, CUSTOM = "rag", "custom"
NOTHING = "Nothing relevant was found."
UNAIDED = "Answer this question about regulations from what you know, in as much detail as you are sure of."


def retrieved(questions: DataFrame, chunks: DataFrame, k: int = 12, threshold: float = 0.35) -> DataFrame:
    """(question_id, rank, id, score, and the chunk's columns) of the best chunks of each question, exact.

    questions: question_id (long), embedding, source; with a source only its chunks are searched, in one
    search for each of the valid sources that is asked for.  A text counts once for a question.
    """
    asked = questions.withColumn("_of", F.lower(F.coalesce("source", F.lit(""))))
    found = None
    for (source,) in sorted(asked.select("_of").distinct().collect()):  # the valid sources and none, at most
        if source and source not in V.VALID_SOURCES:
            raise ValueError(f"unknown source: {source}")
        own = asked.where(F.col("_of") == source).select(F.col("question_id").alias("question"), "embedding")
        some = S.search_many(chunks.where(F.col("source") == source) if source else chunks, own, k)
        found = some if found is None else found.unionByName(some)
    if found is None:
        found = S.search_many(chunks, asked.select(F.col("question_id").alias("question"), "embedding"), k)
    hits = found.where(F.col("score") >= threshold).join(chunks.drop("embedding"), "id")
    best = Window.partitionBy("question", "text").orderBy(F.desc("score"), "id")
    hits = hits.withColumn("_rn", F.row_number().over(best)).where("_rn = 1").drop("_rn")
    rank = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "id"))
    return hits.withColumn("rank", rank).withColumnRenamed("question", "question_id")


def own_answers(questions: DataFrame, hits: DataFrame, model: TextModel) -> DataFrame:
    """(question_id, answer, sources, error): the model's answer from the blocks of a question's hits, and
    what a judge is shown of them.  Without hits the model is not asked.

    hits: of at most a few dozen for each question, with the columns of answers.context_blocks().
    """
    blocks = AN.context_blocks(hits, scores=True, keys=("question_id",)).withColumnRenamed("block", "b")
    shown = AN.judge_sources(hits, keys=("question_id",)).withColumnRenamed("block", "s")
    both = blocks.select("question_id", "rank", "b", F.lit(None).cast("string").alias("s")).unionByName(shown.select("question_id", "rank", F.lit(None).cast("string").alias("b"), "s"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "b", "s")))
    joined = lambda field: F.array_join(F.filter(F.transform("l", lambda x: x[field]), lambda x: x.isNotNull()), "\n\n")
    context = both.groupBy("question_id").agg(ordered.alias("l")).select("question_id", joined("b").alias("context"), joined("s").alias("sources"))
    q = F.col("question")
    number = F.coalesce(T.question_number(q), T.section_reference(q))
    asked = questions.join(context, "question_id", "left").select("question_id", "question", "context", "sources", number.alias("number"), T.asker(q).alias("asker"), AN.wants_analysis(q, number).alias("analysis"), T.sub_questions(q).alias("parts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, question, context, sources, number, asker, analysis, parts in batch.itertuples(index=False):
                try:
                    if context:
                        prompt, _ = AN.answer_prompt(question, context, list(parts if parts is not None else ()))
                        said = model.generate(f"{AN.system_prompt(number, asker, bool(analysis))}\n\n{prompt}")
                    rows.append((i, said if context else NOTHING, sources or "No sources were retrieved.", None))
                except Exception as e:  # noqa: BLE001  whatever the provider raises
                    rows.append((i, None, sources, str(e)[:500]))
            yield pd.DataFrame(rows, columns=["question_id", "answer", "sources", "error"])

    small_batches(questions.sparkSession)
    kind = questions.schema["question_id"].dataType.simpleString()
    return asked.mapInPandas(run, f"question_id {kind}, answer string, sources string, error string")


def baseline_answers(questions: DataFrame, models: dict[str, TextModel]) -> DataFrame:
    """(question_id, baseline, answer, error): what each model says without any sources."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, question in batch.itertuples(index=False):
                for name, model in models.items():
                    try:
                        rows.append((i, name, model.generate(f"{UNAIDED}\n\n{question}").strip(), None))
                    except Exception as e:  # noqa: BLE001
                        rows.append((i, name, None, str(e)[:500]))
            yield pd.DataFrame(rows, columns=["question_id", "baseline", "answer", "error"])

    small_batches(questions.sparkSession)
    kind = questions.schema["question_id"].dataType.simpleString()
    return questions.select("question_id", "question").mapInPandas(run, f"question_id {kind}, baseline string, answer string, error string")


def all_answers(questions: DataFrame, hits: DataFrame, model: TextModel, baselines: dict[str, TextModel]) -> DataFrame:
    """(question_id, baseline, question, answer, truth, sources, error): own answers always, those of the
    named baselines, and the ``custom`` ones that questions bring along.  Only own answers have sources.

    questions: question_id (unique), question, truth, custom.
    """
    if taken := {OWN, CUSTOM} & set(baselines):
        raise ValueError(f"not the name of a baseline: {sorted(taken)[0]}")
    none = F.lit(None).cast("string")
    own = own_answers(questions, hits, model).withColumn("baseline", F.lit(OWN))
    out = own.unionByName(baseline_answers(questions, baselines).withColumn("sources", none)) if baselines else own
    brought = questions.where("custom <> ''").select("question_id", F.lit(CUSTOM).alias("baseline"), F.col("custom").alias("answer"), none.alias("sources"), none.alias("error"))
    said = questions.select("question_id", "question", "truth")
    return out.unionByName(brought).join(said, "question_id").select("question_id", "baseline", "question", "answer", "truth", "sources", "error")


def results(answers: DataFrame, scores: DataFrame) -> DataFrame:
    """(question_id, baseline, answer, total, average, advantage, error) of every answer.

    average has two digits and is 0 where the judge named no criterion; answers that failed, or whose judge
    did, have none.  advantage: the own average of the same question less this one, for all but own answers.
    """
    judged = scores.groupBy("question_id", "baseline").agg(F.sum("score").alias("_t"), F.round(F.avg("score"), 2).alias("_a"), F.max("error").alias("_e"))
    failed = F.coalesce("error", "_e")
    rows = answers.join(judged, ["question_id", "baseline"], "left").select("question_id", "baseline", "answer", *(F.when(failed.isNull(), F.coalesce(c, F.lit(0))).alias(n) for c, n in (("_t", "total"), ("_a", "average"))), failed.alias("error"))
    own = F.max(F.when(F.col("baseline") == OWN, F.col("average"))).over(Window.partitionBy("question_id"))
    return rows.withColumn("advantage", F.when(F.col("baseline") != OWN, F.round(own - F.col("average"), 2)))


def report(found: DataFrame, scores: DataFrame) -> DataFrame:
    """(baseline, questions, failed, mean, advantage, wins, losses, ties, criteria), one row a baseline.

    Each baseline counts over the questions that it has a judged answer to; advantage is the own mean over
    all own answers less the baseline's, both of two digits; criteria: the mean of each criterion.
    """
    d = F.col("advantage")
    ahead = [F.when(F.col("baseline") != OWN, F.count_if(c)).alias(n) for c, n in ((d > 0, "wins"), (d < 0, "losses"), (d == 0, "ties"))]
    by = found.groupBy("baseline").agg(F.count("average").alias("questions"), F.count("error").alias("failed"), F.round(F.avg("average"), 2).alias("mean"), *ahead)
    own = F.max(F.when(F.col("baseline") == OWN, F.col("mean"))).over(Window.partitionBy(F.lit(0)))  # a row for each baseline
    by = by.withColumn("advantage", F.when(F.col("baseline") != OWN, F.round(own - F.col("mean"), 2)))
    means = scores.where("criterion is not null").groupBy("baseline", "criterion").agg(F.round(F.avg("score"), 2).alias("m"))
    criteria = means.groupBy("baseline").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("criterion", "m")))).alias("criteria"))
    return by.join(criteria, "baseline", "left").select("baseline", "questions", "failed", "mean", "advantage", "wins", "losses", "ties", "criteria")


def evaluate(questions: DataFrame, hits: DataFrame, model: TextModel, baselines: dict[str, TextModel], judge: TextModel) -> tuple[DataFrame, DataFrame, DataFrame]:
    """answers' results, the judge's scores, and the report.

    questions: question_id (unique), question, truth, custom; hits: of retrieved(), or of any other search.
    """
    answers = written(all_answers(questions, hits, model, baselines))
    scores = written(AN.judged(answers.where("error is null"), judge))
    found = written(results(answers, scores))
    discard(answers)
    return found, scores, report(found, scores)
