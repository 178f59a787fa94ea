"""Composites: incremental index, graph from chunks, and the steps of a question up to its context."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import dictionary as D
from quarry.functions import fixed_values as V
from quarry.functions import text as T
from quarry.functions.providers import Silent, TextModel, embed, expanded, hashed_embedding, rewritten
from quarry.operators import answers as AN
from quarry.operators import graph as G
from quarry.operators import retrieval as S
from quarry.operators import sections as C
from quarry.operators.keywords import KeywordIndex
from quarry.operators.vectors import VectorIndex


@dataclass(frozen=True)
class Plan:
    """What a question asks for, found on the driver.

    ``phrasings`` are searched one by one; with ``analysis`` all of the circular ``number`` is wanted.
    """

    question: str
    k: int = 12
    threshold: float = 0.35
    number: str | None = None
    analysis: bool = False
    sources: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    intent: str | None = None
    asker: str | None = None
    parts: tuple[str, ...] = ()
    phrasings: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()


def planned(spark, question: str, k: int = 12, source: str | list[str] | None = None, model: TextModel | None = None, several: bool = False) -> Plan:
    """Bounds are checked; a question of several parts asks for 20 chunks at least if k is 12 or less.

    Without a source, those of the domains that the question names are searched.  With ``several`` it is
    also searched in other phrasings.
    """
    if not question or len(question) > 2000 or not 1 <= k <= 20:
        raise ValueError("a question has 1 to 2000 characters and k is 1 to 20")
    sources = tuple(s.lower() for s in ([source] if isinstance(source, str) else source or ()))
    if bad := [s for s in sources if s not in V.VALID_SOURCES]:
        raise ValueError(f"unknown source: {bad[0]}")
    q, model = F.col("q"), model or Silent()
    parts = F.lower(q).rlike(r"\(a\).*\(b\)") | (F.regexp_count(q, F.lit(r"\?")) >= 2) | F.lower(q).rlike(r"(walk through|explain|describe|what are)\b.+,\s+.+,\s+and\s+")
    number = F.coalesce(T.question_number(q), T.section_reference(q))
    found = spark.sql("select :q as q", args={"q": question}).select(number.alias("number"), AN.wants_analysis(q, number).alias("analysis"), F.transform(S.matched_words(q, V.TYPE_WORDS), lambda c: c["name"]).alias("types"), S.most_matched(q, V.INTENT_WORDS).alias("intent"), parts.alias("several"), T.domain_sources(q).alias("sources"), T.asker(q).alias("asker"), T.sub_questions(q).alias("parts"), T.acronyms(q).alias("keywords"))
    row = found.first()
    said = rewritten(question, model)
    return Plan(said, 20 if row["several"] and k <= 12 else k, number=row["number"], analysis=bool(row["analysis"]), sources=sources or tuple(row["sources"] or ()), types=tuple(row["types"]), intent=row["intent"], asker=row["asker"], parts=tuple(row["parts"]), phrasings=tuple(expanded(said, model)) if several else (said,), keywords=tuple(row["keywords"]))


def ask(chunks: DataFrame, plan: Plan, vector: list[float] | None = None, embedded: Callable[[str], list[float]] | None = None, keywords: KeywordIndex | None = None, vectors: VectorIndex | None = None) -> DataFrame:
    """Ranked chunks (rank, id, score, payload) for a plan.

    Chunks of the circular that the question names come first: all of it in its own order for an
    analysis.  Without any, each phrasing goes through the hierarchy (through a flat search where that
    finds nothing), the hits are united and each text counts once; then keyword hits are merged in.
    chunks has id, number, title, source, kind, text, chunk_index and embedding.  vector: of the question
    itself; embedded: of other phrasings.  keywords, vectors: indexes of the same chunks (the payload of the
    latter is chunks' columns), by which only a part of the files is read.
    """
    if vector is None and embedded is None:
        dim = len(chunks.select("embedding").first()[0])
        embedded = lambda text: hashed_embedding(text, dim)
    q = vector or embedded(plan.question)
    rows = chunks.where(F.col("source").isin(*plan.sources)) if plan.sources else chunks
    order = Window.orderBy(F.desc("score"), "id")
    if plan.number:
        hits = S.search(rows, q, 50 if plan.analysis else plan.k, 0.0, F.col("number") == plan.number)
        if not hits.isEmpty():
            return AN.in_order(hits) if plan.analysis else hits.withColumn("rank", F.row_number().over(order))
    found, own_source = None, F.col("source").isin(*plan.sources) if plan.sources else None
    for i, phrase in enumerate(plan.phrasings or (plan.question,)):
        own = q if phrase == plan.question or embedded is None else embedded(phrase)
        fetch = None if vectors is None else lambda n, own=own: vectors.search(own, n, 0.0, own_source)
        hits = S.hierarchical(rows, own, "number", "title", "text", plan.k, 5, "kind", list(plan.types), fetch)
        if hits.isEmpty():
            hits = S.search_by_type(rows, own, "kind", list(plan.types), plan.k, plan.threshold) if plan.types else S.search(rows, own, plan.k, plan.threshold)
        hits = hits.withColumn("pos", F.row_number().over(order) + 1000 * i)  # k rows of each phrasing
        found = hits if found is None else found.unionByName(hits)
    united = S.deduplicated(found, "text", plan.k).withColumn("pos", F.row_number().over(order))
    if not plan.keywords:
        return united.withColumnRenamed("pos", "rank")
    if keywords is None:
        held = rows.where(S.has_keywords(F.split(F.lower("text"), "[^a-z0-9]+"), list(plan.keywords)))
    else:
        held = rows.join(keywords.matching(list(plan.keywords)), "id", "left_semi")
    keyword = S.search(held, q, plan.k, 0.0).withColumn("pos", F.row_number().over(order))
    return S.hybrid_merge(united, keyword, "text", plan.k).drop("pos")


def answer(hits: DataFrame, plan: Plan, model: TextModel, nodes: DataFrame | None = None, edges: dict[str, DataFrame] | None = None, taxonomy: dict[str, tuple[str, ...]] | None = None) -> dict:
    """The model's answer to ranked hits, with what the graph says: freshness of each hit, and the context
    that the question's intent asks for."""
    context = ""
    if nodes is not None:
        hits = AN.annotated(hits, "number", edges["supersedes"])
        topic = AN.topic_named(plan.question, taxonomy or {}) if plan.intent == "cross_reference" else None
        lines = AN.graph_lines(plan.intent or "", nodes, edges, plan.number, AN.source_named(plan.question), topic)
        context = "\n".join(r["line"] for r in lines.orderBy("pos").collect())
    blocks = [r["block"] for r in AN.context_blocks(hits, scores=True).orderBy("rank").collect()]  # k hits
    if not blocks:
        return {"answer": "Nothing relevant was found.", "sources": [], "question": plan.question, "chunks": 0}
    prompt, tokens = AN.answer_prompt(plan.question, "\n\n".join([*([context] if context else []), *blocks]), list(plan.parts))
    said = model.generate(f"{AN.system_prompt(plan.number, plan.asker, plan.analysis)}\n\n{prompt}")
    return {"answer": said, "sources": [r.asDict() for r in hits.select("id", "source", "title", "number", "score").orderBy(F.desc("score"), "id").collect()], "question": plan.question, "chunks": len(blocks), "max_tokens": tokens}


def index(records: DataFrame, stored: DataFrame | None = None, link: str = "link", dim: int = 64, model: TextModel | None = None) -> DataFrame:
    """Chunks with ids and embeddings of the records whose link is not indexed yet.

    What is embedded is a chunk's header, its summary and its text.  A model, if there is one, names the
    kinds and writes the summaries of chunks that the rules leave as general.
    records: id, source, title, date, link, number, content, details, file_name.
    """
    new = records if stored is None else records.join(stored.select(link).where(F.col(link) != "").distinct(), link, "left_anti")
    c = [F.col(x) for x in ("source", "title", "date", "number", link, "content", "details")]
    cut = C.chunks(new.select(F.col("id").alias("doc_id"), T.document_text(*c).alias("text")))
    meta = new.select(F.col("id").alias("doc_id"), "source", "title", "date", link, "number", "file_name")
    out = cut.join(meta, "doc_id").withColumn("chunk_id", T.chunk_id(F.col("file_name"), F.col("title"), F.col("chunk_index")))
    out = out.withColumn("id", T.point_id(F.col("chunk_id"))).withColumn("kind", T.section_type(F.col("heading"), F.col("text")))
    if model is not None:
        out = AN.summarised(AN.reclassified(out, model), model)
    out = out.withColumn("summary", F.col("summary") if model is not None else F.lit(""))
    said = T.embedding_text(F.col("source"), F.col("title"), F.col("date"), F.col("heading"), F.col("kind"), F.col("summary"), F.col("text"))
    return embed(out.withColumn("embedded", said), "embedded", dim).drop("embedded")


def graph_from_chunks(chunks: DataFrame, taxonomy: dict[str, tuple[str, ...]], entities: tuple[str, ...], aliases: DataFrame) -> dict[str, DataFrame]:
    """Vertices and edges of circulars found in chunks (number, title, date, source, link, text, pos)."""
    grouped = G.group_chunks(chunks, "number", "pos").withColumn("text", F.array_join("texts", "\n"))
    circulars = grouped.drop("texts", "text")
    lower = F.lower(F.concat_ws(" ", "title", F.substring("text", 1, 2000)))
    about = grouped.select(F.col("number").alias("src"), F.explode(S.topics(lower, taxonomy)).alias("dst"))
    phrases = F.transform(F.regexp_extract_all("text", F.lit(V.APPLIES_TO), F.lit(1)), F.lower)
    if len(entities) > D.MANY:  # phrases are told apart by a character that no entity holds
        found = D.phrases_in(F.array_join(phrases, "\x00"), tuple(e.lower() for e in entities))
        named = F.filter(F.array(*map(F.lit, entities)), lambda e: F.array_contains(found, F.lower(e)))
    else:
        named = F.filter(F.array(*map(F.lit, entities)), lambda e: F.exists(phrases, lambda p: F.contains(p, F.lower(e))))
    applies = G.canonical(grouped.select(F.col("number").alias("src"), F.explode(named).alias("dst")), "dst", aliases).distinct()
    laws = F.transform(F.regexp_extract_all("text", F.lit(V.AMENDS), F.lit(1)), lambda r: F.regexp_replace(F.trim(r), r"(?i)^(?:the|of|in|to)\s+", ""))
    amends = grouped.select(F.col("number").alias("src"), F.explode(F.array_distinct(F.filter(laws, lambda r: F.length(r).between(10, 150)))).alias("dst"))
    supersedes = C.superseded(grouped.select("number", "text")).withColumnsRenamed({"number": "src", "ref": "dst"})
    return {"circulars": circulars, "about": about, "applies_to": applies, "amends": amends, "supersedes": supersedes}
