"""What surrounds a model's answer: freshness, graph context, context blocks, prompts, and the parsing of
what models return.

Tables are touched by DataFrame operators; a prompt is a text on the driver, made of at most a few dozen
retrieved rows.  Models are protocols (functions.providers), so all of it runs without a network.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import fixed_values as V
from quarry.functions import text as T
from quarry.functions.batches import small_batches
from quarry.functions.providers import TextModel
from quarry.operators import graph as G
from quarry.operators import retrieval as S
from quarry.streaming.progress import written


def annotated(hits: DataFrame, number: str, supersedes: DataFrame) -> DataFrame:
    """Hits with ``freshness_note``: what supersedes their circular, null where nothing does."""
    newer = supersedes.groupBy(F.col("dst").alias(number)).agg(F.max("src").alias("_newer"))
    note = F.concat(F.lit("Superseded by "), F.col("_newer").cast("string"))
    return hits.join(newer, number, "left").withColumn("freshness_note", note).drop("_newer")


def _line(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def graph_lines(intent: str, nodes: DataFrame, edges: dict[str, DataFrame], number=None, source: str | None = None, topic: str | None = None, walk: DataFrame | None = None) -> DataFrame:
    """(pos, line) of the graph context that a question's intent asks for; no rows where it finds nothing.

    nodes: (node, date, source, title); edges: supersedes, applies_to, amends, about as (src, dst).  The
    intents are chain, latest, impact and related (of a circular), summary (of a source) and
    cross_reference (of a topic).  walk: of graph.walked() from the circular, for a caller with several intents.
    """
    spark = nodes.sparkSession
    nothing = spark.createDataFrame([], "pos int, line string")
    if intent in ("chain", "latest", "impact", "related") and number is None:
        return nothing
    one = nodes.where(F.col("node") == number).select("node")
    each = _line("- ", F.col("node"), ": ", F.col("title"), " (", F.col("date"), ")")
    first = lambda text: spark.range(1).select(F.lit(0).alias("pos"), F.lit(text).alias("line"))
    numbered = lambda rows, *order: rows.select(F.row_number().over(Window.orderBy(*order)).alias("pos"), "line")  # noqa: E731  a few rows
    if intent == "chain":
        found = G.chain(edges["supersedes"], one, walk).select("node").join(nodes, "node")
        old = edges["supersedes"].select(F.col("dst").alias("node")).join(found.select("node"), "node", "left_semi")
        newest = found.join(old, "node", "left_anti")
        steps = found.agg(F.array_sort(F.collect_list(F.struct("date", "node"))).alias("c")).where("size(c) > 0")
        joined = F.array_join(F.transform("c", lambda c: _line(c["node"], " (", F.coalesce(c["date"], F.lit("?")), ")")), " → ")
        last = newest.agg(F.max(F.struct("date", "node", "title")).alias("b")).where("b is not null")
        return steps.select(F.lit(1).alias("pos"), _line("[AMENDMENT CHAIN: ", joined, "]").alias("line")).unionByName(last.select(F.lit(2).alias("pos"), _line("[LATEST VERSION: ", F.col("b.node"), " — ", F.col("b.title"), "]").alias("line")))
    if intent == "latest":
        best = G.latest(edges["supersedes"], one, nodes.select("node", "date"), walk).where("latest <> start").join(nodes.select(F.col("node").alias("latest"), "title"), "latest")
        return best.select(F.lit(1).alias("pos"), _line("[NOTE: ", F.col("start"), " has been superseded. Latest version: ", F.col("latest"), " — ", F.col("title"), "]").alias("line"))
    if intent == "impact":
        hit = G.impact(one, edges["applies_to"], edges["amends"])
        of = lambda c, pos, label: hit.where(F.col(c) != "").select(F.lit(pos).alias("pos"), _line(label, F.replace(F.col(c), F.lit(","), F.lit(", ")), "]").alias("line"))
        return of("entities", 1, "[APPLIES TO: ").unionByName(of("regulations", 2, "[AMENDS: "))
    if intent == "related":
        rows = G.related(number, [edges["about"], edges["applies_to"]], nodes)
        lines = numbered(rows.withColumn("line", _line("- ", F.col("node"), ": ", F.col("title"), " (", F.col("source"), ", ", F.col("date"), ")")), F.desc_nulls_first("date"), "node")
        head = first(f"[RELATED CIRCULARS for {number}]")
    elif intent == "summary" and source:
        rows = nodes.where(F.lower("source") == source.lower()).orderBy(F.desc_nulls_first("date"), "node").limit(15)
        lines = numbered(rows.withColumn("line", each), F.desc_nulls_first("date"), "node")
        head = first(f"[CIRCULARS FROM {source.upper()}]")
    elif intent == "cross_reference" and topic:
        rows = written(G.by_topic(nodes, edges["about"], topic, 5))
        under = rows.select("source", "rn", _line("  ", each).alias("line")).unionByName(rows.select("source").distinct().select("source", F.lit(0).alias("rn"), _line("\n  ", F.col("source"), ":").alias("line")))
        lines = numbered(under, "source", "rn")
        head = first(f"[CROSS-REGULATOR VIEW: {topic}]")
    else:
        return nothing
    lines = written(lines)  # a few rows, which are read twice
    some = lines.limit(1).select(F.lit(True).alias("_some"))  # the head stands over rows only
    return head.crossJoin(F.broadcast(some)).drop("_some").unionByName(lines)


def source_named(question: str) -> str | None:
    """The first of the regulators that a question names."""
    return next((s for s in ("rbi", "sebi", "irdai", "mca", "cbic", "cbdt", "icai", "ibbi", "dgft") if s in question.lower()), None)


def topic_named(question: str, taxonomy: dict[str, tuple[str, ...]]) -> str | None:
    """The topic with most keywords in a question, the first of equals; None without any."""
    q = question.lower()
    count = {name: sum(w in q for w in words) for name, words in taxonomy.items()}
    best = max(count, key=count.get, default=None)
    return best if best and count[best] else None


def wants_analysis(question: Column, number: Column) -> Column:
    """Whether a question asks for all of a circular: besides its number and filler words it has fewer
    than 30 letters and digits."""
    rest = F.replace(F.lower(question), F.lower(number), F.lit(""))
    rest = F.regexp_replace(F.regexp_replace(rest, V.ANALYSIS_FILLER, ""), r"(?U)[^\w]", "")
    return (F.coalesce(number, F.lit("")) != "") & (F.length(rest) < 30)


def in_order(hits: DataFrame, index: str = "chunk_index") -> DataFrame:
    """Hits of one document in its own order."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.coalesce(index, F.lit(0)), "id")))  # 50 rows at most


def context_blocks(hits: DataFrame, scores: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, rank, block): a numbered block for each hit, with a header of the parts that it has.

    hits: rank, source, number, title, date, link, kind, chunk_index, total_chunks, text, and score.
    """
    part = lambda label, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{label}: "), F.col(c)))
    place = F.when(F.col("total_chunks") > 1, F.format_string("Part %d of %d", F.col("chunk_index") + 1, "total_chunks"))
    header = [F.concat(F.lit("Source: "), F.col("source")), part("Circular No", "number"), F.concat(F.lit("Title: "), F.col("title")), part("Date", "date"), part("Link", "link"), F.when(F.col("kind") != "general", F.concat(F.lit("Type: "), F.col("kind"))), place]
    header += [F.format_string("Relevance: %.2f", "score")] if scores else []
    return hits.select(*keys, "rank", F.concat(F.format_string("[%d] ", "rank"), F.concat_ws(" | ", *header), F.lit("\n"), F.col("text")).alias("block"))


def judge_sources(hits: DataFrame, most: int = 12, width: int = 1200, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, rank, block) of the first hits with the beginnings of their texts, for a judge."""
    return hits.where(F.col("rank") <= most).select(*keys, "rank", F.concat(F.format_string("[Source %d] ", "rank"), F.concat_ws(" — ", "source", "title"), F.format_string(" (Circular: %s, Relevance: %s)\nContent: ", F.coalesce("number", F.lit("")), F.col("score").cast("string")), F.substring("text", 1, width)).alias("block"))


def zipped(one: DataFrame, other: DataFrame, pos: str = "pos") -> DataFrame:
    """Rows of two result lists side by side, by position; the shorter one ends it."""
    return one.join(other, pos)


# ---- prompts ------------------------------------------------------------------------------------


def answer_prompt(question: str, context: str, parts: list[str]) -> tuple[str, int]:
    """The prompt (question before and after its context, sub-questions numbered) and the tokens allowed."""
    listed = "".join(f"\n  {i}. {q}" for i, q in enumerate(parts, 1))
    block = f"\n\nAddress each of these sub-questions:{listed}" if len(parts) > 1 else ""
    return f"Question: {question}\n\nContext:\n{context}\n\nQuestion: {question}{block}", 3000 if len(parts) > 1 else 2000


def system_prompt(number: str | None, asker: str | None = None, analysis: bool = False) -> str:
    """Instructions; a circular's number is named only if it has at most 50 harmless characters."""
    safe = number if number and re.fullmatch(r"[A-Za-z0-9/\-_. ()]{1,50}", number) else None
    lines = ["Answer from the numbered sources alone and cite them by number."]
    if analysis:
        lines = ["Summarise the whole circular section by section: obligations, dates, limits, exceptions."]
    lines += [f"The question is about circular {safe}."] if safe else []
    lines += [f"The asker is a {asker}: say what applies to them and what does not."] if asker else []
    return "\n".join(lines)


def unfenced(raw: str) -> str:
    """A model's text without a code fence around it."""
    return re.sub(r"\n?```$", "", re.sub(r"^```\w*\n?", "", raw.strip())) if raw.strip().startswith("```") else raw.strip()


def batched(model: TextModel, items: list[dict], size: int, most_failures: int = 5, empty_fails: bool = True) -> dict[int, dict]:
    """A model's entries by the position of their item, asked for in batches.

    A batch that raises or is no JSON list fails (an empty answer if ``empty_fails``); after
    ``most_failures`` in a row the rest is left.  Entries with ids outside their batch are dropped.
    """
    out: dict[int, dict] = {}
    failures = 0
    for begin in range(0, len(items), size):
        batch = items[begin : begin + size]
        try:
            raw = model.generate(json.dumps([{"id": i, **item} for i, item in enumerate(batch)]))
            if not raw:
                failures += empty_fails
            else:
                failures = 0
                for entry in json.loads(unfenced(raw)):
                    if isinstance(at := entry.get("id"), int) and 0 <= at < len(batch):
                        out[begin + at] = entry
        except Exception:  # noqa: BLE001  whatever a provider raises
            failures += 1
        if failures >= most_failures:
            break
    return out


def _by_document(chunks: DataFrame, key: str, column: str, of: Callable[[pd.DataFrame], list]) -> DataFrame:
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema if f.name != column)
    return chunks.groupBy(key).applyInPandas(lambda part: part.drop(columns=[column], errors="ignore").assign(**{column: of(part)}), f"{fields}, `{column}` string")


def reclassified(chunks: DataFrame, model: TextModel, key: str = "doc_id", size: int = 20) -> DataFrame:
    """Kinds of a document's general chunks by a model, if it has more than three; else as they are."""
    known = {name for name, *_ in V.SECTION_TYPES}

    def of(part: pd.DataFrame) -> list:
        part = part.reset_index(drop=True)
        kinds, general = part["kind"].tolist(), [i for i, k in enumerate(part["kind"]) if k == "general"]
        if len(general) > 3:
            for at, entry in batched(model, [{"preview": part["text"][i][:300]} for i in general], size).items():
                if entry.get("type") in known:
                    kinds[general[at]] = entry["type"]
        return kinds

    return _by_document(chunks, key, "kind", of)


def summarised(chunks: DataFrame, model: TextModel, key: str = "doc_id", size: int = 10) -> DataFrame:
    """Adds ``summary`` to general chunks: a model's sentence of context, empty where it says SKIP."""

    def of(part: pd.DataFrame) -> list:
        part = part.reset_index(drop=True)
        out, general = [""] * len(part), [i for i, k in enumerate(part["kind"]) if k == "general"]
        item = lambda r: {"source": r["source"], "title": r["title"][:80], "section": r["heading"][:80], "text": r["text"][:400]}
        for at, entry in batched(model, [item(part.loc[i]) for i in general], size, empty_fails=False).items():
            if (s := entry.get("summary")) and s != "SKIP":
                out[general[at]] = s
        return out

    return _by_document(chunks.withColumn("summary", F.lit("")), key, "summary", of)


def topics_of(text: str, model: TextModel) -> list[dict]:
    """Topics of a meeting by a model, asked twice at most; else one of the whole text."""
    for temperature in (0.0, 0.1):
        try:
            found = json.loads(unfenced(model.generate(text, temperature)))
        except Exception:  # noqa: BLE001
            continue
        if isinstance(found, list) and (found := [t for t in found if isinstance(t, dict) and t.get("title")]):
            return found
    return [{"title": "Meeting Analysis", "summary": "Full document analysis", "start_marker": "", "end_marker": ""}]


def excerpt_of(text: str, start: str, end: str) -> str:
    """From the first start marker through the first end marker; all if they are not there in order."""
    a, b = (text.find(start) if start else -1), (text.find(end) if end else -1)
    return text[a : b + len(end)] if 0 <= a < b else text


def event(kind: str, data) -> str:
    """A server-sent event."""
    return f"event: {kind}\ndata: {json.dumps(data)}\n\n"


def meeting_events(text: str, model: TextModel, search: Callable[[str], str] | None = None) -> Iterator[str]:
    """Events of a meeting's analysis, topic by topic; an error of one topic does not end the others.

    search: context of a query, for topics and, with the first 500 characters, for the whole.
    """
    topics = topics_of(text, model)
    cut = [excerpt_of(text, t.get("start_marker", ""), t.get("end_marker", "")) for t in topics]
    yield event("topics", {"topics": [{"title": t["title"], "summary": t.get("summary", ""), "excerpt_length": len(c)} for t, c in zip(topics, cut, strict=True)]})
    for i, (topic, part) in enumerate(zip(topics, cut, strict=True)):
        yield event("topic_start", {"index": i, "title": topic["title"], "total": len(topics)})
        try:
            more = search(f"{topic['title']} {topic.get('summary', '')}") if search else ""
            yield from answer_events(f"Excerpt:\n{part}\n" + (f"\nRelated circulars:\n{more}\n" if more else "") + f"\nTopic: {topic['title']}\n{topic.get('summary', '')}", model)
        except Exception as e:  # noqa: BLE001
            yield event("error", {"index": i, "title": topic["title"], "error_message": str(e)})
        yield event("topic_end", {"index": i})
    yield event("done", None)


def consolidated_events(text: str, model: TextModel, search: Callable[[str], str] | None = None) -> Iterator[str]:
    """Events of one analysis of a whole meeting, with what its first 500 characters retrieve."""
    more = search(text[:500]) if search else ""
    yield from answer_events(text + (f"\n\nRelated circulars:\n{more}" if more else ""), model)
    yield event("done", None)


def answer_events(prompt: str, model: TextModel, size: int = 40) -> Iterator[str]:
    """The model's text as token events."""
    said = model.generate(prompt)
    yield from (event("token", said[i : i + size]) for i in range(0, len(said), size))


def chat_events(document: str, turns: list[tuple[str, str]], question: str, model: TextModel, last: int = 10) -> Iterator[str]:
    """Events of a follow-up on a document: its text, the last turns (role, text) and the question."""
    if len(document) < 50:
        raise ValueError("text is too short")
    told = "\n".join(f"{role}: {text}" for role, text in turns[-last:])
    yield from answer_events(f"Document:\n{document}\n\n{told}\nuser: {question}", model)
    yield event("done", None)


#: What a judge is told: of every answer, of one with sources, of one without.
JUDGE = "Score the answer from 1 to 5 by each criterion. Return JSON: scores, a list of criterion, score, reasoning."
SOURCED = "Hold its claims against the sources."
UNSOURCED = "It was written without sources: distrust exact numbers and dates, and do not reward vagueness."


def judged(answers: DataFrame, model: TextModel) -> DataFrame:
    """(question_id, baseline, criterion, score, reasoning, error) of a judge's JSON; scores are 1 to 5.

    answers: question_id, baseline, question, answer, truth, sources.  A judge that fails leaves one row
    with its error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, baseline, question, answer, truth, sources in batch.itertuples(index=False):
                blocks = {"Task": f"{JUDGE} {SOURCED if sources else UNSOURCED}", "Question": question, "Answer": answer, "Expected": truth, "Sources": sources}
                try:
                    found = json.loads(unfenced(model.generate("\n\n".join(f"{k}:\n{v}" for k, v in blocks.items() if v))))
                    rows += [(i, baseline, s["criterion"], max(1, min(5, int(s["score"]))), s.get("reasoning", ""), None) for s in found.get("scores", [])]
                except Exception as e:  # noqa: BLE001
                    rows.append((i, baseline, None, None, None, str(e)[:500]))
            yield pd.DataFrame(rows, columns=["question_id", "baseline", "criterion", "score", "reasoning", "error"]).astype({"score": "Int64"})

    small_batches(answers.sparkSession)
    kind = answers.schema["question_id"].dataType.simpleString()
    return answers.select("question_id", "baseline", "question", "answer", "truth", "sources").mapInPandas(run, f"question_id {kind}, baseline string, criterion string, score long, reasoning string, error string")
