"""Whole contents of the queries that SQL cannot express, against plain loops over the same tables."""

import hashlib
import re

import duckdb
import pytest

from quarry.plans import catalog

SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")


def rows(data, sql):
    return duckdb.connect().execute(sql.replace("{}", data)).fetchall()


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def size(text):
    return len(text.split())


def sentences(text):
    out = []
    for paragraph in re.split(r"\n\n+", text):
        found = [s.strip() for s in SENTENCE.split(paragraph.strip()) if s.strip()]
        out += [("\n\n" if out and not i else "") + s for i, s in enumerate(found)]
    return out


def section_chunks(text, target, least, most, overlap):
    """One sentence after the other: a chunk is closed before the sentence that makes it too large."""
    if size(text) <= most:
        return [text.strip()] if text.strip() else []
    out, now = [], []

    def close(next_one=True):
        if now:
            out.append(re.sub(" +", " ", " ".join(s.strip() for s in now).strip()))
        kept = []
        while next_one and now and sum(map(size, kept)) + size(now[-1]) <= overlap:
            kept.insert(0, now.pop())
        now[:] = kept

    fresh = 0
    for s in sentences(text):
        if size(s) > most:
            if fresh:
                close(False)
            now.clear()
            words, fresh = s.split(), 0
            out += [" ".join(words[i : i + target]) for i in range(0, len(words), target)]
            continue
        if fresh and sum(map(size, now)) + size(s) > most and sum(map(size, now)) >= least:
            close()
            fresh = 0
        now.append(s)
        fresh += 1
    if fresh:
        close(False)
    return [x for x in out if x]


def test_chunks_of_whole_documents(spark, data):
    """The tables' texts have no headings: their paragraphs are the sections, short ones join the one before."""
    expected = set()
    for doc_id, text in rows(data, "select doc_id, text from '{}/documents.parquet'"):
        merged = []
        for p in re.split(r"\n\n+", "\n".join(x.strip() for x in [text or ""])):
            if p.strip():
                if merged and size(p) < 50:
                    merged[-1] += "\n\n" + p
                else:
                    merged.append(p)
        cut = [c for m in merged for c in section_chunks(m, 100, 80, 140, 10)]
        expected |= {(doc_id, i, len(cut), size(c), digest(c)) for i, c in enumerate(cut)}
    found = [tuple(r) for r in catalog.queries()["chunk_document"](spark, data).select("doc_id", "chunk_index", "total_chunks", "token_count", "text_sha256").collect()]
    assert len(found) == len(set(found)) and set(found) == expected


def plain_page(html):
    """Title, text and links of a page without nested or unclosed marks, by patterns alone."""
    bare = re.sub(r"(?is)<(script|style|nav|header|footer|noscript)\b.*?</\1\s*>", "", html)
    title = re.search(r"(?is)<title[^>]*>(.*?)</title>", html)
    return (title[1].strip() if title else ""), bare, re.findall(r"(?i)<a\s[^>]*href=[\"']([^\"']*)[\"'][^>]*>(.*?)</a>", html)


def test_pages_and_listings(spark, data):
    import html as marks

    found = {r["page_id"]: r for r in catalog.queries()["html_extract"](spark, data).collect()}
    listed = {}
    for r in catalog.queries()["html_listing"](spark, data).collect():
        listed.setdefault(r["page_id"], []).append(r)
    pages = rows(data, "select page_id, html from '{}/pages.parquet'")
    assert len(found) == len(pages)
    for page_id, source in pages:
        title, bare, links = plain_page(source or "")
        r = found[page_id]
        assert r["title"] == marks.unescape(title) and r["n_links"] == len(re.findall(r"(?i)<a\s[^>]*href=", source or ""))
        assert r["n_pdfs"] == sum(h.lower().split("?")[0].endswith(".pdf") for h, _ in links)
        body = re.search(r"(?is)<body[^>]*>(.*?)</body>", bare)
        inner = next((m[1] for m in (re.search(rf"(?is)<{t}\b[^>]*>(.*)</{t}>", bare) for t in ("main", "article")) if m), body[1] if body else "")
        if not re.search(r"(?i)<table|id=[\"']content[\"']", bare):
            said = "\n".join(marks.unescape(x).strip() for x in re.split(r"<[^>]*>", inner) if x.strip())
            assert r["content_sha256"] == digest(said), (page_id, source[:300])
        if "<tr" not in (source or ""):
            seen, want = set(), []
            for href, label in links:
                label = re.sub(r"\s+", " ", marks.unescape(re.sub(r"<[^>]*>", "", label))).strip()
                if len(label) >= 10 and label not in seen and not re.match(r"javascript:|mailto:|#", href) and "login" not in href.lower():
                    seen.add(label)
                    want.append((len(want), label, "", marks.unescape(href), ""))
            assert [tuple(x)[1:] for x in sorted(listed.get(page_id, []), key=lambda x: x["pos"])] == want


@pytest.fixture(scope="module")
def indexed(spark, data):
    from quarry.operators import assistant

    records = catalog.records(spark, data).withColumnRenamed("crawler", "file_name").withColumn("crawler", catalog.F.col("file_name"))
    return assistant.index(records).collect()


def test_index_has_every_word_once_in_order(spark, data, indexed):
    """The chunks of a record hold its document text in order; ids are of their own; embeddings are unit vectors."""
    query = {(r["doc_id"], r["chunk_index"]): (r["id"], r["kind"]) for r in catalog.queries()["index_records"](spark, data).collect()}
    assert query == {(r["doc_id"], r["chunk_index"]): (r["id"], r["kind"]) for r in indexed} and len(query) == len(indexed)
    by = {}
    for r in indexed:
        by.setdefault(r["doc_id"], []).append(r)
    assert all(sorted(r["chunk_index"] for r in cut) == list(range(cut[0]["total_chunks"])) for cut in by.values())
    for doc_id, text in rows(data, "select doc_id, text from '{}/documents.parquet'"):
        if not (text or "").strip():
            continue
        words = " ".join(r["text"] for r in sorted(by[doc_id], key=lambda r: r["chunk_index"])).split()
        at = 0
        for w in text.split():  # a subsequence: repeats by overlap lie between
            while at < len(words) and words[at] != w:
                at += 1
            assert at < len(words), (doc_id, w)
            at += 1
    assert all(r["summary"] == "" and abs(sum(x * x for x in r["embedding"]) - 1) < 1e-4 for r in indexed)
