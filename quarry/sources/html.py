"""Text, links and listings of HTML pages, by the standard parser, in Arrow maps over pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

from quarry.functions.batches import small_batches

_SKIP = {"script", "style", "nav", "header", "footer", "noscript"}
_VOID = {"br", "hr", "img", "input", "link", "meta", "area", "base", "col", "embed", "source", "track", "wbr"}
_DATE = re.compile(r"\d{1,2}[./-]\d{1,2}[./-]\d{4}|\d{4}-\d{2}-\d{2}|\d{1,2}[ -](?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*[ -]\d{4}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{1,2}, \d{4}")


def table_markdown(rows: list[list[str]]) -> str:
    """Rows as a markdown table: cells on one line, columns and rows without any text dropped."""
    clean = [[re.sub(r"\s+", " ", c).strip() for c in r] for r in rows]
    used = [i for i in range(max(map(len, clean), default=0)) if any(i < len(r) and r[i] for r in clean)]
    kept = [[r[i] if i < len(r) else "" for i in used] for r in clean]
    kept = [r for r in kept if any(r)]
    return "\n".join("| " + " | ".join(r) + " |" for r in [*kept[:1], ["---"] * len(used), *kept[1:]]) if kept else ""


class Page(HTMLParser):
    """Collects the text of main, #content, article and body, links, and table rows.

    A table stands in the text as markdown, where it ends; one within a cell is part of the cell.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str | None]] = []
        self.text: dict[str, list[str]] = {"main": [], "#content": [], "article": [], "body": []}
        self.links: list[list[str]] = []
        self.rows: list[list[tuple[str, str]]] = []
        self.title: list[str] = []
        self.tables: list[list[list[str]]] = []

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag not in _VOID:
            self.open.append((tag, attrs.get("id")))
        if tag == "a" and attrs.get("href"):
            self.links.append([attrs["href"], ""])
        if tag == "table":
            self.tables.append([])
        if tag == "tr":
            self.rows.append([])
            if self.tables:
                self.tables[-1].append([])
        if tag == "td" and self.rows:
            self.rows[-1].append(["", ""])
        if tag in ("td", "th") and self.tables:
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.tables[-1][-1].append("")

    def handle_endtag(self, tag):
        if tag == "table" and self.tables:
            self._table()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def close(self):
        super().close()
        while self.tables:
            self._table()

    def _table(self):
        if not _SKIP & {t for t, _ in self.open}:
            self._say(table_markdown(self.tables.pop()))
        else:
            self.tables.pop()

    def _say(self, text: str):
        if self.tables:
            if self.tables[-1] and self.tables[-1][-1]:
                self.tables[-1][-1][-1] += text
            return
        if not text.strip():
            return
        tags = [t for t, _ in self.open]
        for name in ("main", "article", "body"):
            if name in tags:
                self.text[name].append(text.strip())
        if any(i == "content" for _, i in self.open):
            self.text["#content"].append(text.strip())

    def handle_data(self, data):
        tags = {t for t, _ in self.open}
        if "title" in tags:
            self.title.append(data)
        if "a" in tags and self.links:
            self.links[-1][1] += data
        if _SKIP & tags:
            return
        if "td" in tags and self.rows and self.rows[-1]:
            self.rows[-1][-1][0] += data
            if "a" in tags:
                self.rows[-1][-1][1] += data
        self._say(data)


def parsed(html: str | None) -> Page:
    page = Page()
    page.feed(html or "")
    page.close()
    return page


def main_text(page: Page) -> str:
    """The first of main, #content, article and body that has text."""
    return next(("\n".join(page.text[k]) for k in ("main", "#content", "article", "body") if page.text[k]), "")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, title, content, n_links, pdf_links) of every page; a null page is empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, html in batch.itertuples(index=False):
                p = parsed(html)
                rows.append((i, "".join(p.title).strip(), main_text(p), len(p.links), [h for h, _ in p.links if h.lower().split("?")[0].endswith(".pdf")]))
            yield pd.DataFrame(rows, columns=["page_id", "title", "content", "n_links", "pdf_links"])

    small_batches(pages.sparkSession)
    return pages.select("page_id", "html").mapInPandas(run, "page_id long, title string, content string, n_links int, pdf_links array<string>")


def listing(pages: DataFrame) -> DataFrame:
    """(page_id, pos, title, date, link, details) of listing pages.  A row's link is that of its anchor.

    Rows of tables with two cells or more: title is the first anchor's text, else the longest cell.
    Without such rows: links with a title of ten characters or more, each title once.
    """

    def records(p: Page) -> list[tuple]:
        out = []
        for row in p.rows:
            cells = [re.sub(r"\s+", " ", c).strip() for c, _ in row]
            if len(cells) >= 2:
                anchor = next((re.sub(r"\s+", " ", a).strip() for _, a in row if a.strip()), "")
                title = anchor or max(cells, key=len)
                if len(title) >= 5:
                    out.append((title, next((m[0] for c in cells if (m := _DATE.search(c))), ""), "", " | ".join(c for c in cells if c)))
        seen: set[str] = set()
        if not out:
            for href, label in p.links:
                title = re.sub(r"\s+", " ", label).strip()
                if len(title) >= 10 and title not in seen and not re.match(r"javascript:|mailto:|#", href) and "login" not in href.lower():
                    seen.add(title)
                    out.append((title, "", href, ""))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(i, k, *r) for i, html in batch.itertuples(index=False) for k, r in enumerate(records(parsed(html)))], columns=["page_id", "pos", "title", "date", "link", "details"])

    small_batches(pages.sparkSession)
    return pages.select("page_id", "html").mapInPandas(run, "page_id long, pos int, title string, date string, link string, details string")
