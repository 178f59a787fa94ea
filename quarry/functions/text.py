"""Text and date functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import fixed_values as V


def _or(columns) -> Column:
    return reduce(lambda a, b: a | b, columns)


def normalize_source(raw: Column) -> Column:
    """Source key: a trailing bracketed sub-type is cut, lower case; unknown ones keep the raw text."""
    base = F.lower(F.trim(F.regexp_replace(raw, r"\s*\(.*\)\s*$", "")))
    return F.when(F.coalesce(raw, F.lit("")) == "", "other").when(base.isin(*V.VALID_SOURCES), base).otherwise(F.lower(raw))


def display_source(raw: Column) -> Column:
    """Upper-case part before the first bracket, hyphen or slash; empty is Unknown."""
    head = F.upper(F.trim(F.split(raw, r"[\(\-/]")[0]))
    return F.when(F.coalesce(raw, F.lit("")) == "", "Unknown").when(head != "", head).otherwise(F.upper(F.trim(raw)))


def clean_content(text: Column) -> Column:
    """Without a leading file size; three or more newlines become two; trimmed."""
    cut = F.regexp_replace(text, r"(?is)^\(\s*\d+\s*kb\s*\)\s*", "")
    return F.coalesce(F.regexp_replace(F.regexp_replace(cut, r"\n{3,}", "\n\n"), r"^\s+|\s+$", ""), F.lit(""))


def _parsed(date: Column, formats: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.try_to_timestamp(F.trim(date), F.lit(f)) for f in formats))


def iso_date(date: Column) -> Column:
    """yyyy-MM-dd where one of four formats fits, else the trimmed text; null as empty."""
    return F.coalesce(F.date_format(_parsed(date, V.ISO_FORMATS), "yyyy-MM-dd"), F.trim(date), F.lit(""))


def _number(text: Column, pattern: str, group: int) -> Column:
    return F.try_element_at(F.array(F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))), F.lit(1)).cast("int")


def record_year(title: Column, date: Column, details: Column) -> Column:
    """Year by date field, a dotted date in details, the second year of an RBI number, a year in the title."""
    title, details = (F.coalesce(c, F.lit("")) for c in (title, details))
    return F.coalesce(
        F.year(_parsed(date, V.YEAR_FORMATS)),
        _number(details, r"\b(\d{1,2})\.(\d{1,2})\.(\d{4})\b", 3),
        _number(F.concat_ws(" ", title, details), r"RBI/(\d{4})-(\d{4})/", 2),
        _number(title, r"\b((19|20)\d{2})\b", 1),
    )


def is_important(title: Column, date: Column, details: Column, cutoff: int = V.CUTOFF_YEAR) -> Column:
    """Master documents and amendments; before the cutoff, or undated, also those with keywords."""
    text = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(details, F.lit("")))
    late = F.coalesce(record_year(title, date, details) >= cutoff, F.lit(False))
    return text.rlike(V.MASTER) | text.rlike(V.AMENDMENT) | (~late & text.rlike(V.KEYWORDS))


def short_year(reference: Column) -> Column:
    """2025-2026 as 2025-26, upper case."""
    return F.regexp_replace(F.upper(reference), r"(\d{4})-\d{2}(\d{2})", "$1-$2")


def record_number(number: Column, content: Column) -> Column:
    """A record's circular number, or the first in its first 500 characters; else empty."""
    return F.coalesce(F.nullif(number, F.lit("")), F.regexp_extract(F.substring(content, 1, 500), V.RECORD_REFERENCE, 0), F.lit(""))


def question_number(question: Column) -> Column:
    """A circular number named in a question, normalized; null without."""
    return F.nullif(short_year(F.regexp_extract(question, V.QUESTION_REFERENCE, 0)), F.lit(""))


def section_reference(question: Column) -> Column:
    """CGST-S16 for a section of an act, CGST_RULES-R89 for a rule; null without."""
    name = lambda pattern: F.replace(F.upper(F.regexp_extract(question, pattern, 2)), F.lit(" "), F.lit("_"))
    section, rule = (F.regexp_extract(question, p, 1) for p in (V.SECTION_OF_ACT, V.RULE_OF_RULES))
    return F.when(section != "", F.concat(name(V.SECTION_OF_ACT), F.lit("-S"), section)).when(rule != "", F.concat(name(V.RULE_OF_RULES), F.lit("_RULES-R"), rule))


def acronyms(text: Column, most: int = 3) -> Column:
    """The first upper-case words of two letters or more that are not generic; repeats stay."""
    found = F.regexp_extract_all(text, F.lit(r"(?U)\b[A-Z]{2,}\b"), F.lit(0))
    return F.slice(F.filter(found, lambda a: ~a.isin(*V.GENERIC_ACRONYMS)), 1, most)


def key_terms(question: Column, stop_words: tuple[str, ...]) -> Column:
    """Lower-case words of three letters or more without marks and stop words."""
    words = F.transform(F.split(F.lower(question), r"\s+"), lambda w: F.btrim(w, F.lit("?,.'\"")))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*stop_words))


def sentences(text: Column) -> Column:
    """Sentences: paragraphs apart, then after . ! or ? before white space and a capital.

    The first sentence of each paragraph but the first begins with two newlines.
    """
    paragraphs = F.filter(F.transform(F.split(text, r"\n\n+"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    cut = F.transform(paragraphs, lambda p: F.split(F.regexp_replace(p, r"([.!?])\s+([A-Z])", "$1\x01$2"), "\x01"))
    marked = F.transform(cut, lambda s, i: F.transform(s, lambda x, k: F.when((i > 0) & (k == 0), F.concat(F.lit("\n\n"), x)).otherwise(x)))
    return F.flatten(marked)


def _needed(pattern: str) -> str | None:
    """The longest word that every match of a pattern holds, if that can be told: outside of groups, classes
    and escapes, and not optional."""
    bare = re.sub(r"\\.[?*]?|\[[^\]]*\][?*+]?|\((?:[^()\\]|\\.)*\)[?*+]?", " ", pattern)
    return None if "|" in bare or "(" in bare or "(?" in pattern.replace("(?:", "") else max(re.findall(r"[A-Za-z]{2,}(?![?*{A-Za-z])", bare), key=len, default=None)


def section_type(heading: Column, body: Column) -> Column:
    """The first type whose words are in the heading or whose patterns are in the lower-case body.

    A pattern is tried only on a body that holds the word which each of its matches has; the body is put in
    lower case once.
    """

    def of(heading: Column, body: Column) -> Column:
        def held(p: str) -> Column:
            found = body.rlike(p)
            return F.contains(body, F.lit(w)) & found if (w := _needed(p)) else found

        out = None
        for name, words, patterns, least in V.SECTION_TYPES:
            count = reduce(lambda a, b: a + b, (held(p).cast("int") for p in patterns))
            hit = _or([F.contains(heading, F.lit(w)) for w in words]) | (count >= least)
            out = F.when(hit, name) if out is None else out.when(hit, name)
        return out.otherwise("general")

    both = F.array(F.struct(F.lower(heading).alias("h"), F.lower(body).alias("b")))
    return F.transform(both, lambda x: of(x["h"], x["b"]))[0]


def topic_label(heading: Column, body: Column) -> Column:
    """Heading without its number, else the body's first sentence; lower case, cut."""
    head = F.trim(F.regexp_replace(heading, r"(?i)^(?:\d+\.[\d.]*\s*|(?:X{0,3})(?:IX|IV|V?I{0,3})\.\s*|\(\d+\)\s*)", ""))
    first = F.split(F.regexp_replace(F.trim(body), r"([.!?])\s+([A-Z])", "$1\x01$2"), "\x01")[0]
    return F.when(F.length(head) > 2, F.substring(F.lower(head), 1, 80)).otherwise(F.coalesce(F.lower(F.substring(F.trim(first), 1, 60)), F.lit("")))


def excerpt(text: Column, start: Column, end: Column) -> Column:
    """From the first start marker through the first end marker; the whole text if they are not in order."""
    a, b = F.position(start, text), F.position(end, text)
    return F.when((a > 0) & (b > a), F.substring(text, a, b - a + F.length(end))).otherwise(text)


def topics_json(raw: Column) -> Column:
    """The text of a non-empty JSON array, without a code fence; else null."""
    bare = F.when(F.trim(raw).startswith("```"), F.regexp_replace(F.regexp_replace(F.trim(raw), r"^```\w*\n?", ""), r"\n?```$", "")).otherwise(F.trim(raw))
    parsed = F.try_parse_json(bare)
    return F.when((F.schema_of_variant(parsed).startswith("ARRAY")) & F.try_variant_get(parsed, "$[0]", "variant").isNotNull(), bare)


def normalize_topic(subject: Column) -> Column:
    """Lower case without a leading phrase, single blanks, each run of letters capitalized."""
    topic = F.lower(F.trim(subject))
    for prefix in ("regarding ", "re: ", "circular on ", "notification on "):
        topic = F.when(topic.startswith(prefix), F.substring(topic, len(prefix) + 1, 10_000)).otherwise(topic)
    runs = F.split(F.trim(F.regexp_replace(topic, r"\s+", " ")), r"(?<!\p{L})(?=\p{L})")
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substring(r, 2, 10_000))), "")


def sanitized(identifier: Column) -> Column:
    """The identifier if it has at most 50 harmless characters, else empty."""
    return F.when(identifier.rlike(r"^[A-Za-z0-9/\-_. ()]{1,50}$"), identifier).otherwise("")


def chunk_id(file_name: Column, title: Column, index: Column) -> Column:
    return F.concat_ws(":", file_name, F.substring(title, 1, 50), F.concat(F.lit("chunk_"), index.cast("string")))


def point_id(chunk: Column) -> Column:
    """The first 60 bits of the id's sha256."""
    return F.conv(F.substring(F.sha2(chunk.cast("binary"), 256), 1, 15), 16, 10).cast("long")


def content_hash(content: Column) -> Column:
    """sha256 of non-empty content."""
    return F.when(F.coalesce(content, F.lit("")) != "", F.sha2(content.cast("binary"), 256))


def document_text(source: Column, title: Column, date: Column, number: Column, link: Column, content: Column, details: Column) -> Column:
    """A header of the parts that are there, and the content or else title and details."""
    part = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))
    known = lambda c, default: F.coalesce(c, F.lit(default))
    head = F.concat_ws(" | ", F.concat(F.lit("Source: "), known(source, "Unknown")), F.concat(F.lit("Title: "), known(title, "Untitled")), part("Date: ", iso_date(date)), part("Circular Number: ", record_number(number, content)), part("Link: ", link))
    body = clean_content(content)
    body = F.when(body != "", body).otherwise(F.concat_ws("\n\n", known(title, "Untitled"), F.nullif(details, F.lit(""))))
    return F.concat(F.lit("["), head, F.lit("]\n\n"), body)


def embedding_text(source: Column, title: Column, date: Column, heading: Column, kind: Column, summary: Column, text: Column) -> Column:
    """What is embedded of a chunk: a short header, the summary and the text."""
    part = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))
    head = F.concat_ws(" | ", F.nullif(F.upper(source), F.lit("")), F.nullif(F.substring(title, 1, 100), F.lit("")), F.nullif(date, F.lit("")), part("Section: ", F.substring(heading, 1, 80)), part("Type: ", kind))
    return F.concat_ws("\n", F.concat(F.lit("["), head, F.lit("]")), F.nullif(summary, F.lit("")), text)


def table_markdown(rows: Column) -> Column:
    """array<array<string>> as a markdown table: empty columns and rows dropped, cells on one line."""
    cell = lambda c: F.trim(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")))
    clean = F.transform(rows, lambda r: F.transform(r, cell))
    width = F.array_max(F.transform(clean, F.size))
    used = F.filter(F.sequence(F.lit(0), width - 1), lambda i: F.exists(clean, lambda r: F.coalesce(F.get(r, i), F.lit("")) != ""))
    kept = F.filter(F.transform(clean, lambda r: F.transform(used, lambda i: F.coalesce(F.get(r, i), F.lit("")))), lambda r: F.exists(r, lambda c: c != ""))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.size(used)), " | "), F.lit(" |"))
    body = F.transform(F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0))), line)
    return F.when((F.size(rows) > 0) & (F.size(kept) > 0), F.array_join(F.concat(F.array(line(kept[0]), rule), body), "\n")).otherwise("")


def sub_questions(question: Column) -> Column:
    """The parts of a question that end in a question mark and are longer than ten characters, or all of it."""
    parts = F.filter(F.transform(F.split(question, r"\?"), lambda p: F.trim(p)), lambda p: F.length(p) > 10)
    return F.when(F.size(parts) > 0, F.transform(parts, lambda p: F.concat(p, F.lit("?")))).otherwise(F.array(F.trim(question)))


def asker(question: Column) -> Column:
    """The kind of entity that the asker says to be; null without."""
    return F.nullif(F.trim(F.regexp_extract(question, V.ASKER, 1)), F.lit(""))


def domain_sources(question: Column) -> Column:
    """Sorted sources of all domains with a word in the question; null without any.  Words match anywhere."""
    q = F.lower(question)
    found = [F.when(_or([F.contains(q, F.lit(w)) for w in words]), F.array(*map(F.lit, sources))).otherwise(F.array().cast("array<string>")) for words, sources in V.DOMAINS.values()]
    all_ = F.array_sort(F.array_distinct(F.concat(*found)))
    return F.when(F.size(all_) > 0, all_)


def all_attachments(links: Column, single: Column) -> Column:
    """The list of attachments with the single one, if that is not in it."""
    listed = F.coalesce(links, F.array().cast("array<string>"))
    return F.when(F.coalesce(single, F.lit("")) == "", listed).otherwise(F.array_union(listed, F.array(single)))
