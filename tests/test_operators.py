"""Operators on small fixtures: upserts, chunks, sections, graph, html, sources, streams, providers."""

import json

from pyspark.sql import functions as F

from quarry.functions import providers
from quarry.operators import assistant, graph, records, retrieval, sections
from quarry.sources import connectors, html
from quarry.sources import records as src
from quarry.streaming import progress


def test_upsert_policy(spark):
    schema = "link string, title string, content string, n int, pos int"
    old = spark.createDataFrame([("a", "t0", "c0", 5, 0), ("b", "t0", "c0", 9, 0)], schema).drop("pos")
    new = spark.createDataFrame([("a", "t1", "c1", 3, 1), ("a", "t2", "", 4, 2), (None, "x", "y", 1, 3), ("c", "n", None, 1, 4)], schema)
    out = records.upsert(old, new, "link", {"title": "overwrite", "content": "keep_if_empty", "n": "greatest"}, "pos")
    assert sorted(map(tuple, out.collect()), key=str) == sorted([("a", "t2", "c1", 5), ("b", "t0", "c0", 9), ("c", "n", None, 1), (None, "x", "y", 1)], key=str)


def test_json_and_csv(spark):
    one = spark.createDataFrame([('{"a": "1", "b": "2"}', '{"b": "3"}')], "x string, y string")
    assert json.loads(one.select(records.merge_json(F.col("x"), F.col("y"))).first()[0]) == {"a": "1", "b": "3"}
    a, b = spark.createDataFrame([("1", ["x", "y"])], "p string, q array<string>"), spark.createDataFrame([("2",)], "r string")
    out = records.csv_rows(a, b)
    assert out.columns == ["p", "q", "r"] and {tuple(r) for r in out.collect()} == {("1", "x, y", None), (None, None, "2")}


def test_chunk_texts_keep_limits():
    s = " ".join(["W" + " ".join(["w"] * 29) + "." for _ in range(20)] + ["X " + " ".join(["x"] * 249)])
    out = sections.chunk_texts(s, 100, 80, 140, 40, sections.count_tokens)
    assert all(sections.count_tokens(c) <= 140 for c in out)
    assert sum(c.count("x") for c in out) == 249 and out[-1].count("x") == 50


def test_chunks_cover_documents(spark):
    text = "1. Scope\nBanks shall file. They must keep it.\n2. Limits\n" + "Word one two. " * 300
    out = sections.chunks(spark.createDataFrame([(1, text), (2, "short"), (3, None), (4, "")], "doc_id long, text string"), 100, 80, 140, 10).orderBy("doc_id", "chunk_index").collect()
    assert {r["doc_id"] for r in out} == {1, 2}
    one = [r for r in out if r["doc_id"] == 1]
    assert [r["chunk_index"] for r in one] == list(range(len(one))) and all(r["total_chunks"] == len(one) for r in one)
    assert max(r["token_count"] for r in one) <= 140


def test_legislation_rules_and_directions(spark):
    rules = "x\n" + "\n".join(f"Rule {i}. — Title {i} — body {i}." for i in range(1, 7)) + "\nFORM A"
    found = sections.split_parts(spark.createDataFrame([(1, rules)], "doc_id long, text string"), "rules").orderBy("pos").collect()
    assert [r["part"] for r in found] == ["1", "2", "3", "4", "5", "6", "FORMS"]
    direction = "Chapter I - First\nalpha\nChapter II - Second\nbeta"
    found = sections.split_parts(spark.createDataFrame([(1, direction)], "doc_id long, text string"), "direction").orderBy("pos").collect()
    assert [(r["part"], r["title"]) for r in found] == [("Chapter I", "First"), ("Chapter II", "Second")]
    assert sections.split_parts(spark.createDataFrame([(1, "plain")], "doc_id long, text string"), "act").first()["title"] == "Full Text"


def test_graph_with_a_cycle(spark):
    edges = spark.createDataFrame([(3, 2), (2, 1), (1, 3), (5, 4)], "src long, dst long")
    start = spark.createDataFrame([(2,)], "node long")
    assert {r["node"] for r in graph.chain(edges, start).collect()} == {1, 2, 3}
    nodes = spark.createDataFrame([(4, "2020"), (5, "2021"), (6, "2022")], "node long, date string")
    latest = graph.latest(edges.where("src = 5"), spark.createDataFrame([(4,), (6,)], "node long"), nodes)
    assert {tuple(r) for r in latest.collect()} == {(4, 5), (6, 6)}


def test_graph_with_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(3000)], "src long, dst long")
    start = spark.createDataFrame([(1000,)], "node long")
    assert {r["node"] for r in graph.chain(edges, start).collect()} == set(range(3001))
    nodes = spark.range(3001).selectExpr("id as node", "'2020' as date")
    assert [tuple(r) for r in graph.latest(edges, start, nodes).collect()] == [(1000, 3000)]


def test_allocations(spark):
    g = spark.createDataFrame([("a", 0.9, 1), ("b", 0.5, 2), ("c", 0.4, 3)], "number string, best double, rank int")
    assert {r["number"]: r["slots"] for r in retrieval.allocations(g, 12).collect()} == {"a": 8, "b": 2, "c": 2}
    g = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2), ("c", 0.4, 3)], "number string, best double, rank int")
    assert {r["number"]: r["slots"] for r in retrieval.allocations(g, 12).collect()} == {"a": 4, "b": 4, "c": 3}


def test_html():
    page = html.parsed("<html><head><title>T</title><script>x</script></head><body><nav>menu</nav><main>Hello <b>you</b></main><a href='/a.pdf'>A long enough title</a></body></html>")
    assert html.main_text(page) == "Hello\nyou" and page.links == [["/a.pdf", "A long enough title"]]
    assert html.main_text(html.parsed(None)) == ""


def test_listing(spark):
    page = "<table><tr><td>1</td><td><a href='x'>Circular on things</a></td><td>10-01-2024</td></tr></table>"
    row = html.listing(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")).collect()
    assert [(r["title"], r["date"]) for r in row] == [("Circular on things", "10-01-2024")]


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"source": "RBI (circular)", "title": "x"}]')
    (tmp_path / "b.md").write_text("---\ntitle: \"T\"\ntopic: gst\n---\nBody\n")
    assert src.json_folder(spark, str(tmp_path)).first()["source"] == "rbi"
    row = src.markdown_folder(spark, str(tmp_path)).first()
    assert row["fields"]["title"] == "T" and row["content"] == "Body\n"


def test_incremental_stream_adds_each_key_once(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([(1, "a"), (2, "b"), (1, "a")], [(2, "b"), (3, "c")]):
        spark.createDataFrame(rows, "k long, v string").write.mode("append").parquet(source)
        progress.load_new(spark.readStream.schema("k long, v string").parquet(source), target, "k")
    assert sorted(r["k"] for r in spark.read.parquet(target).collect()) == [1, 2, 3]


def test_providers_fall_back(spark):
    assert providers.rewritten("q", providers.Silent()) == "q" and providers.expanded("q", providers.Silent()) == ["q"]
    docs = spark.createDataFrame([(1, "short"), (2, "long " * 30)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in providers.extracted(docs, providers.Silent()).collect()}
    assert out[1]["error"] == "text is too short" and out[2]["raw"] is None
    assert len(providers.embed(docs, "text").first()["embedding"]) == 64


def test_connectors(spark):
    cells = spark.createDataFrame([(["1", "60", "2025-26", "A trade notice", "01/02/2026"], ["https://content.dgft.gov.in/x"]), (["1", "60/2025-26", "2025-26", "", "01/02/2026"], []), (["1"], [])], "cells array<string>, links array<string>")
    got = {(r["title"], r["circular_number"], r["link"]) for r in connectors.trade(cells, "n", "https://d").collect()}
    assert got == {("A trade notice", "60/2025-26", "https://content.dgft.gov.in/x"), ("60/2025-26", "60/2025-26", "https://d/CP/?opt=n&num=60/2025-26")}
    links = spark.createDataFrame([("Some title of ours - (01-02-2024)", "https://x/a.PDF"), ("short", "https://x"), ("A long enough text", "mailto:x")], "text string, href string")
    assert [tuple(r)[1:] for r in connectors.accountants(links, "l").collect()] == [("Some title of ours", "01-02-2024", "https://x/a.PDF", ["https://x/a.PDF"])]
    item = '{"id": 7, "circularNo": "12", "circularName": "N", "circularDt": "2024-03-05T00:00:00", "docFilePath": "a\\\\b.pdf"}'
    row = connectors.tax_documents(spark.createDataFrame([(item, 1000001, "Cat"), ("{}", 1, None)], "body string, tax_id int, category string"), "circular", "https://c").collect()
    assert [(r["title"], r["date"], r["link"], r["details"], r["source"]) for r in row] == [("N", "05-Mar-2024", "https://c/content/pdf/a/b.pdf", "12 | Cat", "CBIC (GST)")]
    meeting = spark.createDataFrame([("51st Meeting", "28th & 29th June 2022", "Delhi", [("u1", "")], [("u2", "M")])], "name string, date_text string, venue string, agenda array<struct<url:string,text:string>>, minutes array<struct<url:string,text:string>>")
    assert [(r["title"], r["date"], r["circular_number"]) for r in connectors.council(meeting).collect()] == [("M", "2022-06-29", "GST-COUNCIL-51"), ("Agenda - 51st Meeting", "2022-06-29", "GST-COUNCIL-51")]
    one = spark.createDataFrame([("1 to 25 of 60", "x?file=a.pdf&b", "RBI/2024\nMarch 1, 2024\ntext")], "p string, f string, t string")
    r = one.select(connectors.more_pages(F.col("p")).alias("m"), connectors.framed_pdf(F.col("f")).alias("f"), connectors.detail_lines(F.col("t")).alias("d")).first()
    assert (r["m"], r["f"], r["d"]["number"], r["d"]["date"]) == (True, "a.pdf", "RBI/2024", "March 1, 2024")


def test_index_then_ask(spark):
    text = "1. Scope\nNBFC lenders shall file returns within 30 days and must keep records.\n2. Limits\nExposure of 10 % or 5 crore."
    recs = spark.createDataFrame([(1, "rbi", "KYC norms", "10-01-2024", "l1", "RBI/2024-25/1", text, "", "f"), (2, "sebi", "Brokers", "", "l2", "", "Stock brokers must register. " * 5, "", "g")], "id long, source string, title string, date string, link string, number string, content string, details string, file_name string")
    chunks = assistant.index(recs)
    stored = spark.createDataFrame(chunks.collect(), chunks.schema)
    assert assistant.index(recs, stored).count() == 0
    exact = assistant.ask(stored, assistant.planned(spark, "What does RBI/2024-2025/1 say?")).collect()
    assert exact and {r["number"] for r in exact} == {"RBI/2024-25/1"}
    plan = assistant.planned(spark, "Which NBFC must file returns?", source="rbi")
    assert plan.sources == ("rbi",) and "rule" in plan.types
    assert {r["source"] for r in assistant.ask(stored, plan).collect()} == {"rbi"}
