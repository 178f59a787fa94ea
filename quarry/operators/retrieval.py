"""Retrieval over a table of embedded chunks: cosine top-k, filters, hierarchy, merging and ranking.

A search filters before it scores, and takes the top by TakeOrderedAndProject.  All ties are broken by
``id``.  Hits carry (id, score) and the payload columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import dictionary as D
from quarry.functions.batches import small_batches


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine with a fixed query, in double precision; 0 where a norm is 0."""
    q = F.array(*(F.lit(float(x)) for x in query))
    v = F.transform(vector, lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)) * float(sum(float(x) * float(x) for x in query) ** 0.5)
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot / norm)


def best(hits: DataFrame, k: int) -> DataFrame:
    return hits.orderBy(F.desc("score"), "id").limit(k)


def search(chunks: DataFrame, query: list[float], k: int = 12, threshold: float = 0.35, where: Column | None = None) -> DataFrame:
    """The k best chunks at or above the threshold."""
    rows = chunks if where is None else chunks.where(where)
    return best(rows.withColumn("score", F.round(cosine(F.col("embedding"), query), 6)).drop("embedding").where(F.col("score") >= threshold), k)


#: Scores that a task holds at once in a search for many questions.
CELLS = 1 << 20


def _best_of(found: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    """The first k of each question of (question, id, score): higher scores first, ties by smaller id."""
    question, own, score = found
    order = np.lexsort((own, -score, question))
    question = question[order]
    first = np.flatnonzero(np.concatenate([[True], question[1:] != question[:-1]]) if len(question) else [])
    kept = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order)))) < k
    return question[kept], own[order][kept], score[order][kept]


def search_many(chunks: DataFrame, questions: DataFrame, k: int, block: int = 2048) -> DataFrame:
    """(question, id, score): the k best chunks of each question, exact.

    Questions go in blocks of a bounded number, one pass over the chunks each: a pass multiplies matrices
    of at most CELLS scores, and a task returns k rows for each question, whatever it has read.
    """
    small_batches(chunks.sparkSession)
    blocks = max(1, -(-questions.count() // block))
    out = None
    for b in range(blocks):
        rows = questions.where(F.pmod(F.xxhash64("question"), F.lit(blocks)) == b).orderBy("question").collect()
        ids = np.array([r["question"] for r in rows], dtype=np.int64)
        q = np.array([r["embedding"] for r in rows], dtype=np.float64).reshape(len(rows), -1 if rows else 0)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

        def run(batches: Iterator[pa.RecordBatch], q: np.ndarray = q, ids: np.ndarray = ids) -> Iterator[pa.RecordBatch]:
            step = max(k, CELLS // max(1, len(ids)))
            least = np.full(len(ids), -np.inf)  # the k-th score of each question so far
            held = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
            for batch in batches:
                for i in range(0, batch.num_rows if len(ids) else 0, step):
                    part = batch.slice(i, step)
                    own = np.asarray(part.column(0))
                    x = np.array(part.column(1).to_pylist(), dtype=np.float64).reshape(len(own), -1)
                    norm = np.linalg.norm(x, axis=1, keepdims=True)
                    s = np.where(norm > 0, x @ q.T / np.maximum(norm, 1e-300), 0.0).round(6).T
                    if len(own) >= k:
                        least = np.fmax(least, np.partition(s, len(own) - k, axis=1)[:, len(own) - k])
                    at, column = np.nonzero(~(s < least[:, None]))
                    held = _best_of(tuple(np.concatenate(two) for two in zip(held, (at, own[column], s[at, column]), strict=True)), k)
                    full = np.flatnonzero(np.diff(held[0], append=-1)) if len(held[0]) else np.zeros(0, dtype=np.int64)  # the last row of each question
                    full = full[np.bincount(held[0], minlength=len(ids))[held[0][full]] == k]
                    least[held[0][full]] = np.fmax(least[held[0][full]], held[2][full])
            if len(held[0]):
                yield pa.RecordBatch.from_arrays([pa.array(ids[held[0]]), pa.array(held[1]), pa.array(held[2])], names=["question", "id", "score"])

        found = chunks.where("embedding is not null").select(F.col("id").cast("long"), "embedding").mapInArrow(run, "question long, id long, score double")
        out = found if out is None else out.unionByName(found)
    w = Window.partitionBy("question").orderBy(F.desc("score"), "id")
    return out.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


# The shortest and longest words that count in a keyword search.
SHORTEST, LONGEST = 2, 20


def searched_words(keyword: str) -> list[str]:
    """The lower-case words of a keyword that count."""
    return [w for w in keyword.lower().split() if SHORTEST <= len(w) <= LONGEST]


def has_keywords(tokens: Column, keywords: list[str]) -> Column:
    """Any keyword whose words that count are all among the tokens; a keyword of no others is not found."""
    held = [words for k in keywords if (words := searched_words(k))]
    return reduce(lambda a, b: a | b, (F.size(F.array_except(F.array(*map(F.lit, words)), tokens)) == 0 for words in held), F.lit(False))


def boosted(hits: DataFrame, kind: str, preferred: list[str], k: int, boost: float = 0.1) -> DataFrame:
    """Scores of preferred types raised, then cut."""
    return best(hits.withColumn("score", F.round(F.col("score") + F.when(F.col(kind).isin(*preferred), boost).otherwise(0.0), 6)), k)


def search_by_type(chunks: DataFrame, query: list[float], kind: str, preferred: list[str], k: int, threshold: float) -> DataFrame:
    """Twice as many as asked for, preferred types raised, then cut."""
    return boosted(search(chunks, query, 2 * k, threshold), kind, preferred, k)


def top_groups(hits: DataFrame, number: str, k: int) -> DataFrame:
    """(number, best) of the k best numbered groups, ranked."""
    groups = hits.where(F.coalesce(number, F.lit("")) != "").groupBy(number).agg(F.max("score").alias("best"))
    return groups.orderBy(F.desc("best"), number).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("best"), number)))  # at most k rows


def top_orphans(hits: DataFrame, number: str, title: str, k: int, each: int = 3) -> DataFrame:
    """The best chunks of the k best titles among hits without a number."""
    w = Window.partitionBy(title)
    loose = hits.where(F.coalesce(number, F.lit("")) == "").withColumn("_best", F.max("score").over(w)).withColumn("_rn", F.row_number().over(w.orderBy(F.desc("score"), "id")))
    ranked = loose.withColumn("_group", F.dense_rank().over(Window.orderBy(F.desc("_best"), title)))  # an over-fetch: at most 10 k rows
    return ranked.where(f"_group <= {k} and _rn <= {each}").drop("_best", "_rn", "_group")


def allocations(groups: DataFrame, k: int) -> DataFrame:
    """Slots for each ranked group.

    A group above 0.6 and 1.2 times the next takes most, the others two each; else slots follow the
    scores, at least two, until none remain.
    """
    all_ = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    top, second, n, total = F.first("best").over(all_), F.nth_value("best", 2).over(all_), F.count("*").over(all_), F.sum("best").over(all_)
    dominant = (top > 0.6) & ((n == 1) | (top > F.coalesce(second, F.lit(0.0)) * 1.2))
    g = groups.withColumns({"dominant": dominant, "n": n, "slots": F.greatest(F.lit(2), F.bround(F.coalesce(F.try_divide(F.lit(k) * F.col("best"), total), F.lit(0.0))).cast("int"))})
    before = F.coalesce(F.sum("slots").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share = F.greatest(F.lit(0), F.least(F.col("slots"), F.lit(k) - before))
    most = F.greatest(F.lit(k) - 2 * (F.col("n") - 1), F.lit(k // 2))
    return g.withColumn("slots", F.when(F.col("dominant"), F.when(F.col("rank") == 1, most).otherwise(2)).otherwise(share).cast("int")).drop("dominant", "n").where("slots > 0")


def hierarchical(chunks: DataFrame, query: list[float], number: str, title: str, text: str, k: int, groups: int = 5, kind: str | None = None, preferred: list[str] | None = None, fetch: Callable[[int], DataFrame] | None = None) -> DataFrame:
    """Best groups first, then chunks within each by its slots, then loose chunks of other texts.

    The second step searches whole groups without the source filter of the first.  fetch: finds so many of
    the best chunks by an index; then only chunks of the best groups are scored.
    """
    within = chunks
    if fetch:
        fetched = fetch(10 * groups)
        numbers = [r[0] for r in top_groups(fetched, number, groups).collect()]  # at most ``groups``
        within = chunks.where(F.col(number).isin(numbers))
    scored = within.withColumn("score", F.round(cosine(F.col("embedding"), query), 6)).drop("embedding").where("score >= 0")
    fetched = fetched if fetch else best(scored, 10 * groups)
    slots = allocations(top_groups(fetched, number, groups), k)
    # at most ``groups`` rows
    within = scored.join(F.broadcast(slots.select(number, "slots")), number).withColumn("_rn", F.row_number().over(Window.partitionBy(number).orderBy(F.desc("score"), "id"))).where("_rn <= slots").drop("_rn", "slots")
    both = within.select(*chunks.drop("embedding").columns, "score", F.lit(0).alias("_from")).unionByName(top_orphans(fetched, number, title, groups).select(*chunks.drop("embedding").columns, "score", F.lit(1).alias("_from")))
    first = Window.partitionBy(F.substring(text, 1, 200)).orderBy("_from", F.desc("score"), "id")
    merged = both.withColumn("_rn", F.row_number().over(first)).where("_from = 0 or _rn = 1").drop("_from", "_rn")
    return boosted(merged, kind, preferred, k) if preferred else best(merged, k)


def deduplicated(hits: DataFrame, text: str, k: int, prefix: int = 100) -> DataFrame:
    """The best hit of each text prefix; the earlier of equals."""
    w = Window.partitionBy(F.substring(text, 1, prefix)).orderBy(F.desc("score"), "pos")
    return hits.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn").orderBy(F.desc("score"), "pos").limit(k)


def hybrid_merge(vector: DataFrame, keyword: DataFrame, text: str, k: int) -> DataFrame:
    """Up to k / 2 keyword hits, then vector hits, each text prefix once, in that order (column rank).

    Both inputs have their rank in ``pos``.
    """
    both = keyword.where(F.col("pos") <= k // 2).withColumn("_from", F.lit(0)).unionByName(vector.withColumn("_from", F.lit(1)))
    first = Window.partitionBy(F.substring(text, 1, 100)).orderBy("_from", "pos")
    kept = both.withColumn("_rn", F.row_number().over(first)).where("_rn = 1")
    return kept.withColumn("rank", F.row_number().over(Window.orderBy("_from", "pos"))).where(F.col("rank") <= k).drop("_rn", "_from")  # two result lists


def pruned(hits: DataFrame, ratio: float = 0.7, least: int = 3) -> DataFrame:
    """Hits at a ratio of the best score or above, at least the first few; by rank, not score order."""
    all_ = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    top = F.first("score").over(all_)
    marked = hits.withColumn("_keep", (top <= 0) | (F.col("score") >= top * ratio)).withColumn("_rn", F.row_number().over(Window.orderBy("pos")))
    enough = F.sum(F.col("_keep").cast("int")).over(all_) >= least
    return marked.withColumn("_enough", enough).where(f"(_enough and _keep) or (not _enough and _rn <= {least})").drop("_keep", "_rn", "_enough")


def coherent(hits: DataFrame, key: str, relevance: DataFrame, ratio: float = 0.7, least: int = 3) -> DataFrame:
    """Pruned by score, the title's relevance and how many chunks a document has."""
    joined = hits.join(relevance.select(key, "title_relevance"), key, "left")
    density = F.when(F.count("*").over(Window.partitionBy(key)) >= 2, 1.0).otherwise(0.85)
    adjusted = joined.withColumn("adjusted", F.round(F.col("score") * (0.7 + 0.3 * F.coalesce("title_relevance", F.lit(0.5))) * density, 6))
    order = Window.orderBy(F.desc("adjusted"), "id")
    ranked = adjusted.withColumn("pos", F.row_number().over(order))
    out = pruned(ranked.withColumn("_s", F.col("score")).withColumn("score", F.col("adjusted")), ratio, least)
    return out.withColumn("score", F.col("_s")).drop("_s", "title_relevance").withColumnRenamed("pos", "rank")


def ranked_sources(hits: DataFrame, key: str, date: str, as_of: str, recent: bool = False, relevance: Column | None = None) -> DataFrame:
    """Sources by their best chunk, decayed by age, lowered if off topic, cut relative to the best."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "id")
    one = hits.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    rate, floor, cut, most, unknown = (0.20, 0.30, 0.90, 5, 5.0) if recent else (0.04, 0.70, 0.75, 8, 0.0)
    years = F.coalesce(F.date_diff(F.lit(as_of).cast("date"), F.try_to_timestamp(F.col(date), F.lit("yyyy-MM-dd")).cast("date")) / F.lit(365.25), F.lit(unknown))
    score = F.round(F.round("score", 4) * F.greatest(F.lit(floor), 1.0 - years * rate), 4)
    if relevance is not None:
        r = F.coalesce(relevance, F.lit(0.5))
        score = F.when(r < 0.5, F.round(score * (0.7 + 0.6 * r), 4)).otherwise(score)
    order = Window.orderBy(F.desc("relevance_score"), key)
    out = one.withColumn("relevance_score", score)
    out = out.withColumn("rank", F.row_number().over(order)).withColumn("_top", F.max("relevance_score").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return out.where((F.col("relevance_score") >= F.col("_top") * cut) & (F.col("rank") <= most)).drop("_top")


def matched_words(text: Column, words: dict[str, tuple[str, ...]]) -> Column:
    """Array of (name, count, pos) of the names whose words occur in the lower-case text."""
    if sum(map(len, words.values())) > D.MANY:
        return D.matched(text, words)
    counts = [F.struct(F.lit(n).alias("name"), reduce(lambda a, b: a + b, (F.contains(F.lower(text), F.lit(w)).cast("int") for w in ws)).alias("count"), F.lit(i).alias("pos")) for i, (n, ws) in enumerate(words.items())]
    return F.filter(F.array(*counts), lambda c: c["count"] > 0)


def most_matched(text: Column, words: dict[str, tuple[str, ...]]) -> Column:
    """The name with most words in the text, the first of equals; null without any."""
    found = F.transform(matched_words(text, words), lambda c: F.struct(c["count"].alias("count"), (-c["pos"]).alias("pos"), c["name"].alias("name")))
    return F.array_max(found)["name"]


def topics(text: Column, taxonomy: dict[str, tuple[str, ...]], least: int = 2, most: int = 3) -> Column:
    """Up to ``most`` topics with at least ``least`` keywords in the text, best first, then in their order."""
    found = F.filter(matched_words(text, taxonomy), lambda c: c["count"] >= least)
    ordered = F.array_sort(F.transform(found, lambda c: F.struct((-c["count"]).alias("n"), c["pos"].alias("pos"), c["name"].alias("name"))))
    return F.transform(F.slice(ordered, 1, most), lambda c: c["name"])


def context_block(hits: DataFrame) -> DataFrame:
    """One row: numbered context blocks of ranked hits, joined (rank, source, title, score, text)."""
    block = F.format_string("[%d] %s | %s | Relevance: %.2f\n%s", "rank", "source", "title", "score", "text")
    return hits.agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("x")).select(F.array_join(F.col("x.b"), "\n\n---\n\n").alias("context"))
