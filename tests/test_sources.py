"""Sources, sinks, connectors, streams and what surrounds an answer, on small fixtures."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quarry.functions import providers
from quarry.functions import text as T
from quarry.operators import answers, assistant, graph, records, retrieval, sections
from quarry.sources import connectors as N
from quarry.sources import html, sinks
from quarry.sources import records as src
from quarry.streaming import progress


class Model:
    """Answers from a list in turn; an exception among them is raised."""

    def __init__(self, *said):
        self.said, self.asked = list(said), []

    def generate(self, prompt: str, temperature: float = 0.0) -> str:
        self.asked.append(prompt)
        now = self.said.pop(0) if len(self.said) > 1 else self.said[0]
        if isinstance(now, Exception):
            raise now
        return now


def one(df, *columns):
    return df.select(*columns).first()


# ---- sources --------------------------------------------------------------------------------------


def test_json_folder_skips_malformed_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"source": "RBI (x)", "title": "t"}, {"source": "odd", "title": "u"}]))
    (tmp_path / "b.json").write_text('[{"source": "sebi", "title":')
    rows = src.json_folder(spark, str(tmp_path)).where("title is not null").orderBy("title").collect()
    assert [(r["source"], r["title"], r["_file_name"]) for r in rows] == [("rbi", "t", "a.json"), ("odd", "u", "a.json")]


def test_open_table_merges_the_tail(spark):
    df = spark.createDataFrame([(1, "t", '{"venue": "Delhi", "n": 3}'), (2, "u", None)], "id int, title string, extra string")
    rows = src.open_table(df, "venue string, n int").orderBy("title").collect()
    assert [tuple(r) for r in rows] == [("t", "Delhi", 3), ("u", None, None)]


def test_union_of_collections_and_first_that_loads(spark):
    a, b = spark.createDataFrame([(1, "x")], "_id int, t string"), spark.createDataFrame([(2, 5)], "_id int, n int")
    rows = src.union_all({"a": a, "b": b}).orderBy("_file_name").collect()
    assert [(r["t"], r["n"], r["_file_name"]) for r in rows] == [("x", None, "a"), (None, 5, "b")]

    def broken():
        raise OSError("no connection")

    assert src.first_available(broken, lambda: 7) == 7
    with pytest.raises(OSError):
        src.first_available(broken, broken)


def test_obligations_since_and_without_a_document(spark):
    results = spark.createDataFrame([(2, 10, "2024-05-01 00:00:00"), (1, 11, "2024-01-01 00:00:00")], "id int, doc_id int, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    docs = spark.createDataFrame([(10, "t")], "doc_id int, title string")
    assert [(r["id"], r["title"]) for r in src.obligations(results, docs).collect()] == [(1, None), (2, "t")]
    assert [r["id"] for r in src.obligations(results, docs, "2024-02-01").collect()] == [2]


def test_extractions_as_objects_or_strings(spark, tmp_path):
    for held in ({"circular_reference": "R"}, json.dumps({"circular_reference": "R"})):
        (tmp_path / "d.json").write_text(json.dumps([{"id": 1, "extraction": held}]))
        assert src.demo_obligations(spark, str(tmp_path / "d.json"), "circular_reference string").first()["extraction"]["circular_reference"] == "R"


def test_pdf_folder_by_a_given_parser(spark, tmp_path):
    for name, body in (("a", b"long"), ("b", b"short"), ("c", b"broken")):
        (tmp_path / f"{name}.pdf").write_bytes(body)

    def pages(content):
        if content == b"broken":
            raise ValueError
        return [("A page of text that is long enough to stand for itself, so to say.", [[["h", "k"], ["1\n2", None]]])] if content == b"long" else [("x", [])]

    rows = {r["path"][-5:]: (r["text"], r["method"]) for r in src.pdf_folder(spark, str(tmp_path), pages, lambda content: "what a scan shows, which is again a text of more than fifty characters").collect()}
    assert rows["a.pdf"][0].endswith("| h | k |\n| --- | --- |\n| 1 2 |  |") and rows["a.pdf"][1] == "parsed"
    assert rows["b.pdf"] == ("what a scan shows, which is again a text of more than fifty characters", "mixed") and rows["c.pdf"] == ("", "failed")


def test_fetch_tries_again_and_keeps_the_error(spark, tmp_path):
    class Stub(src.Fetched):
        WAIT = 0.0
        folder = str(tmp_path)

        @classmethod
        def name(cls):
            return "stub_fetch"

        def get(self, url):
            import pathlib

            seen = pathlib.Path(self.folder) / url
            seen.write_text((seen.read_text() if seen.exists() else "") + "x")
            if url == "bad" or (url == "late" and len(seen.read_text()) < 3):
                raise OSError(f"no answer from {url}")
            return 200, url.encode()

    spark.dataSource.register(Stub)
    rows = {r["url"]: r for r in spark.read.format("stub_fetch").option("urls", "good\nlate\nbad").load().collect()}
    assert rows["good"]["status"] == 200 and bytes(rows["late"]["body"]) == b"late" and rows["bad"]["error"] == "no answer from bad"
    assert {p.name: len(p.read_text()) for p in tmp_path.iterdir()} == {"good": 1, "late": 3, "bad": 4}


def test_base64_cache_and_uploads(spark):
    df = spark.createDataFrame([('{"data": "aGk="}',)], "body string")
    assert bytes(one(df, src.base64_document(F.col("body")).alias("b"))["b"]) == b"hi"
    docs, cache = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(1, b"c")], "id int, raw_bytes binary")
    got = {r["id"]: bytes(r["raw_bytes"]) for r in N.cached_first(docs, cache, ["id"], F.lit(b"f")).collect()}
    assert got == {1: b"c", 2: b"f"}
    parts = spark.createDataFrame([(1, 1, "second"), (1, 0, "first")], "id int, pos int, text string")
    text = one(N.merged_upload(parts, "id"), "text")["text"]
    assert text.index("Original") < text.index("first") < text.index("Amendment 1") < text.index("second")
    pdfs = spark.createDataFrame([([("u", "one"), ("v", "two"), ("w", "three")],), ([("u", "one"), ("v", "")],), ([],)], "p array<struct<url:string,text:string>>")
    assert [r[0] for r in pdfs.select(N.joined_pdfs(F.col("p"))).collect()] == ["--- PDF: u ---\none\n\n--- PDF: v ---\ntwo\n\n--- PDF: w ---\nthree", "one", ""]
    assert one(pdfs, N.best_content(F.lit("html"), F.col("p")).alias("c"))["c"] == "--- PDF: u ---\none\n\n--- PDF: v ---\ntwo"
    assert [r[0] for r in spark.createDataFrame([("abcd", "abcdefg"), ("abcd", "abcdef"), ("a", None)], "h string, p string").select(N.preferred_content(F.col("h"), F.col("p"))).collect()] == ["abcdefg", "abcd", "a"]
    assert [r[0] for r in spark.createDataFrame([("short", "p" * 60), ("c" * 60, "p" * 90), (None, None)], "c string, p string").select(F.length(records.with_fallback(F.col("c"), F.col("p")))).collect()] == [60, 60, None]


def test_html_tables_are_markdown_in_their_place():
    page = html.parsed("<body><main>before<table><tr><th>a</th><th> </th><th>b</th></tr><tr><td>1\n2</td><td></td><td>x<table><tr><td>in</td></tr></table></td></tr><tr><td></td></tr></table>after<nav><table><tr><td>no</td></tr></table></nav></main></body>")
    assert html.main_text(page) == "before\n| a | b |\n| --- | --- |\n| 1 2 | x| in | | --- | |\nafter"
    assert html.main_text(html.parsed("<body><article>t<table><tr><td>open")) == "t\n| open |\n| --- |"


def test_html_listing_has_dates_links_and_details(spark):
    pages = [(1, "<table><tr><td>12-01-2024</td><td><a href='/c'>A circular on lending</a></td></tr><tr><td>x</td></tr></table>"), (2, "<a href='/long'>A link with a long title</a><a href='#'>Another long title here</a><a href='/s'>short</a>"), (3, None)]
    rows = [tuple(r) for r in html.listing(spark.createDataFrame(pages, "page_id long, html string")).collect()]
    assert rows == [(1, 0, "A circular on lending", "12-01-2024", "", "12-01-2024 | A circular on lending"), (2, 0, "A link with a long title", "", "/long", "")]


# ---- connectors -----------------------------------------------------------------------------------


def test_bank_records_and_selection(spark):
    rows = [(["Jan 5, 2024", "On lending by banks"], "/x.aspx", "RBI/2023-24/1\nJanuary 5, 2024\ntext", "a pdf text that is longer than the page is, surely"), (["no date", "Other"], "http://b/y", "RBI/2023-24/2\nMarch 1, 2023\nlong " + "x" * 60, "p"), ([], "z", None, None)]
    out = N.bank_circulars(spark.createDataFrame(rows, "cells array<string>, href string, html_text string, pdf_text string"), "https://bank")
    got = [(r["title"], r["date"], r["circular_number"], r["link"], r["content"][:5]) for r in out.collect()]
    assert got == [("On lending by banks", "Jan 5, 2024", "RBI/2023-24/1", "https://bank/x.aspx", "a pdf"), ("no date", "March 1, 2023", "RBI/2023-24/2", "http://b/y", "RBI/2")]
    assert [r["link"] for r in N.selective(out, spark.createDataFrame([("http://b/y",)], "link string"), F.col("title").contains("lending")).collect()] == ["https://bank/x.aspx"]


def test_market_records_and_pages(spark):
    rows = [(" T ", "d", "Circular No.: S/1", "h", "view?file=https://p.pdf&x=1"), ("U", "d", None, "h", None), (" ", "d", "", "h", "")]
    got = [(r["title"], r["circular_number"], r["pdf_links"]) for r in N.market_circulars(spark.createDataFrame(rows, "title string, date string, number_text string, href string, frame string")).collect()]
    assert got == [("T", "S/1", ["https://p.pdf"]), ("U", "", [])]
    pages = lambda *texts: [r["page"] for r in N.pages_until_end(spark.createDataFrame(list(enumerate(texts)), "page int, text string")).orderBy("page").collect()]
    assert pages("1 to 25 of 60", "26 to 50 of 60", "51 to 60 of 60", "1 to 25 of 60") == [0, 1, 2]
    assert pages("1 to 25 of 60", "", None, "26 to 50 of 60", "", "", "", "51 to 52 of 60") == [0, 1, 2, 3, 4, 5, 6]


def test_ministry_insurers_and_direct_taxes(spark):
    body = json.dumps({"documentDetails": json.dumps([{"docID": "a b/c", "docName": "Rule", "docDate": "1"}, {"docID": "x", "docName": " ", "docDate": None}])})
    assert [tuple(r) for r in N.company_circulars(spark.createDataFrame([(body,)], "body string"), "https://m").collect()] == [("mca", "Rule", "1", "https://m/content/dms?doc=a+b%2Fc")]
    pages = [(1, 0, "A", "d", "l1", False), (1, 1, "B", "d", "l2", True), (2, 0, "B", "d", "l2", True), (2, 1, "C", "d", "l3", False), (3, 0, "A", "d", "l1", False), (4, 0, "D", "d", "l4", False)]
    out = N.insurer_circulars(spark.createDataFrame(pages, "page int, pos int, title string, date string, link string, archived boolean")).orderBy("link").collect()
    assert [(r["link"], r["archive_status"]) for r in out] == [("l1", "current"), ("l2", "archived"), ("l3", "current")]
    assert N.years_to_visit(30, [2024]) == [2024] and N.years_to_visit(0, [2024]) == [] == N.years_to_visit(31, [2024])
    rows = [("1/2024 - On returns 5-1-2024", "1/2024", "5-1-2024", "l", 0), ("again", "", "", "l", 1), ("x", "x", "", "m", 2)]
    assert [tuple(r) for r in N.direct_tax_circulars(spark.createDataFrame(rows, "text string, number string, date string, link string, pos int")).collect()] == [("cbdt", "On returns", "5-1-2024", "1/2024", "l")]


def test_keys_of_parts(spark):
    df = spark.createDataFrame([("16", "my notes.md", "Master Direction: X", "https://u")], "part string, file string, name string, url string")
    assert one(N.synthetic_keys(df, "CGST"), "circular_number", "link")[:] == ("CGST-S16", "legislation://CGST/16")
    assert one(N.synthetic_keys(df, "CGST_RULES"), "circular_number")[0] == "CGST_RULES-R16"
    assert one(N.practitioner_keys(df), "circular_number")[0] == "PKB-MY_NOTES-S16"
    assert one(N.direction_keys(df), "circular_number", "link")[:] == ("RBI_MD-Master_Direction__X-16", "https://u#16")


def test_gazettes_insolvency_and_cells(spark):
    cells = ["1", "Min", "Dept", "Off", "Title", "Part", "i", "p", "CG-DL-E-16022026-7", "9 MB"]
    r = N.gazettes(spark.createDataFrame([(cells,), (cells[:9],)], "cells array<string>"), "daily", "https://e").collect()
    assert len(r) == 1 and (r[0]["title"], r[0]["link"], r[0]["dept"]) == ("Title", "https://e/WriteReadData/2026/7.pdf", "Dept")
    rows = [(["1", "d", "A subject (2 MB)"], ["newwindow1('/a.pdf')", "x"]), (["1", "d", "abc"], []), (["1", "e", "Without files"], [])]
    got = [(r["title"], r["link"], r["pdf_links"]) for r in N.insolvency(spark.createDataFrame(rows, "cells array<string>, onclicks array<string>"), "rules", "https://b").collect()]
    assert got == [("A subject", "https://b/a.pdf", ["https://b/a.pdf"]), ("Without files", "https://b/legal-framework/rules/e", [])]
    assert one(spark.range(1), N.date_cell(F.array(F.lit("x"), F.lit("5 Feb"), F.lit("1/2/2024"))).alias("d"))["d"] == "5 Feb"


# ---- sinks ----------------------------------------------------------------------------------------


def test_files_and_snapshots(spark, tmp_path):
    a, b = spark.createDataFrame([(1, ["x", "y"])], "id int, l array<string>"), spark.createDataFrame([(2, 'q"r')], "id int, t string")
    sinks.write_csv(str(tmp_path / "c"), a, b)
    rows = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("1", "x, y", None), ("2", None, 'q"r')]
    sinks.write_json(a, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first()["l"] == ["x", "y"]
    path = str(tmp_path / "s")
    src.write_snapshot(spark.createDataFrame([(1, "a"), (2, "b")], "n int, s string"), path, "s")
    src.write_snapshot(spark.createDataFrame([(3, "b")], "n int, s string"), path, "s")
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, "a"), (3, "b")]


def test_tables_vectors_edges_and_nodes(spark):
    for _ in range(2):
        sinks.ensure_table(spark, "made_once", "a int, b string, c string", "c", "a", 2)
    assert spark.table("made_once").columns == ["a", "b", "c"]
    spark.sql("drop table made_once")
    chunk = lambda *rows: spark.createDataFrame(rows, "chunk_id string, v int, pos int")
    stored = sinks.upsert_vectors(None, chunk(("a", 1, 0), ("b", 1, 1), ("a", 2, 2)), "pos")
    assert {(r["chunk_id"], r["v"]) for r in stored.collect()} == {("a", 2), ("b", 1)}
    again = sinks.upsert_vectors(stored, chunk(("b", 9, 0)), "pos").collect()
    assert {(r["chunk_id"], r["v"]) for r in again} == {("a", 2), ("b", 9)} and len({r["id"] for r in again}) == 2
    edges = sinks.merge_edges(spark.createDataFrame([("a", "b")], "src string, dst string"), spark.createDataFrame([("a", "b"), ("b", "c"), ("", "c"), (None, "d")], "src string, dst string"))
    assert {tuple(r) for r in edges.collect()} == {("a", "b"), ("b", "c")}
    nodes = sinks.merge_nodes(spark.createDataFrame([("a", "old"), ("z", "z")], "k string, t string"), spark.createDataFrame([("a", "new", 1), ("a", "newer", 2)], "k string, t string, pos int"), "k", "pos")
    assert {tuple(r) for r in nodes.collect()} == {("a", "newer"), ("z", "z")}


def test_document_store_is_idempotent(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "link string, n int").write.mode("append").json(str(tmp_path / "in"))
    out = tmp_path / "out"
    out.mkdir()
    folder = str(out)

    def write(rows):
        import pathlib

        for r in rows:
            (pathlib.Path(folder) / r["link"]).write_text(str(r["n"]))

    for i in range(2):
        stream = spark.readStream.schema("link string, n int").json(str(tmp_path / "in"))
        sinks.into_store(stream, "link", write, str(tmp_path / f"check{i}"))
    assert {p.name: p.read_text() for p in out.iterdir()} == {"a": "1", "b": "2"}


def test_report_and_dead_letters(spark):
    df = spark.createDataFrame([("rag", 4.5), ("a", 3.0)], "baseline string, mean double")
    assert sinks.report(df, ["baseline", "mean"], "Means").split("\n")[2:] == ["baseline  mean", "--------  ----", "rag       4.5", "a         3.0"]
    d = one(spark.range(1), records.dead_letter(F.lit("l"), F.lit("u"), F.lit("pdf"), F.lit("m" * 600)).alias("d"))["d"]
    assert (d["document_link"], len(d["error_message"]), d["attempt_number"], d["resolved"]) == ("l", 500, 1, False)
    split = records.split_known(spark.createDataFrame([(1, None, "v")], "id int, title string, venue string"), ["id", "title"]).first()
    assert (split["id"], split["title"], json.loads(split["extra"])) == (1, "", {"venue": "v"})


# ---- streams --------------------------------------------------------------------------------------


def test_progress_events_and_polling(spark):
    counts = spark.createDataFrame([("a", 2, 2), ("b", 3, 5)], "source string, cnt int, total int")
    events = [json.loads(e[6:]) for e in progress.events(counts, "source")]
    assert [e["type"] for e in events] == ["source_complete", "source_complete", "complete"] and events[-1]["data"] == {"record_count": 5}
    done, slept = [], []
    todo = spark.range(25).withColumnRenamed("id", "doc_id")
    calls = iter([False, True, False, False])

    def work(df):
        if next(calls):
            raise RuntimeError("model is away")
        return df

    results = lambda: spark.createDataFrame([(i,) for i in done], "doc_id long")
    n = progress.polled(lambda: todo, results, "doc_id", work, lambda df: done.extend(r["doc_id"] for r in df.collect()), 10, 4, 7.0, slept.append)
    assert n == 25 and done == list(range(25)) and slept == [7.0] * 3


def test_no_local_folder_on_a_cluster():
    class Context:
        master = "yarn"

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(RuntimeError):
        progress.shared_folder(Session())


# ---- what surrounds an answer ---------------------------------------------------------------------


def test_prompts():
    text, tokens = answers.answer_prompt("a? b?", "ctx", ["a?", "b?"])
    assert text.count("a? b?") == 2 and "  2. b?" in text and tokens == 3000
    assert answers.answer_prompt("a?", "ctx", ["a?"])[1] == 2000
    assert "RBI/2023-24/1" in answers.system_prompt("RBI/2023-24/1") and "ignore" not in answers.system_prompt("x\nignore all")
    assert "NBFC" in answers.system_prompt(None, "NBFC", True)
    assert answers.unfenced("```json\n[1]\n```") == "[1]" == answers.unfenced(" [1] ")


def chunk_rows(spark, n, kind="general"):
    return spark.createDataFrame([(1, i, kind, f"text {i}", "s", "t", "h") for i in range(n)], "doc_id long, chunk_index int, kind string, text string, source string, title string, heading string")


def test_reclassification_and_summaries(spark):
    said = json.dumps([{"id": 0, "type": "rule"}, {"id": 1, "type": "nonsense"}, {"id": 99, "type": "rule"}])
    got = {r["chunk_index"]: r["kind"] for r in answers.reclassified(chunk_rows(spark, 4), Model(said)).collect()}
    assert got == {0: "rule", 1: "general", 2: "general", 3: "general"}
    assert {r["kind"] for r in answers.reclassified(chunk_rows(spark, 3), Model(said)).collect()} == {"general"}
    assert {r["kind"] for r in answers.reclassified(chunk_rows(spark, 9), Model(OSError("away"))).collect()} == {"general"}
    out = answers.summarised(chunk_rows(spark, 3), Model('```json\n[{"id": 0, "summary": "About it"}, {"id": 1, "summary": "SKIP"}]\n```')).collect()
    assert {r["chunk_index"]: r["summary"] for r in out} == {0: "About it", 1: "", 2: ""}


def test_batches_end_after_five_failures():
    model = Model(*[""] * 20)
    assert answers.batched(model, [{"n": i} for i in range(100)], 5) == {} and len(model.asked) == 5
    model = Model("", "[]", "")
    assert answers.batched(model, [{"n": i} for i in range(30)], 5) == {} and len(model.asked) == 6


def test_meetings_and_chat():
    topics = [{"title": "Rates", "start_marker": "one", "end_marker": "two"}, {"title": "Fees"}]
    model = Model(json.dumps(topics), "said of rates", OSError("away"))
    events = list(answers.meeting_events("zero one x two three", model, lambda q: f"[about {q.strip()}]"))
    kinds = [e.split("\n")[0][7:] for e in events]
    assert kinds == ["topics", "topic_start", "token", "topic_end", "topic_start", "error", "topic_end", "done"]
    assert json.loads(events[0].split("data: ")[1])["topics"][0]["excerpt_length"] == len("one x two") and "[about Rates]" in model.asked[1]
    assert answers.topics_of("x", Model("no json", "[]"))[0]["title"] == "Meeting Analysis"
    assert list(answers.consolidated_events("m" * 600, Model("all"), lambda q: str(len(q))))[-1].startswith("event: done")
    model = Model("ok")
    list(answers.chat_events("d" * 50, [("user", str(i)) for i in range(20)], "q", model))
    assert "user: 10" in model.asked[0] and "user: 9\n" not in model.asked[0]
    with pytest.raises(ValueError):
        list(answers.chat_events("short", [], "q", model))


def test_judges(spark):
    rows = [(1, "rag", "q", "a", "t", "s"), (2, "gpt", "q", "a", None, None)]
    df = spark.createDataFrame(rows, "question_id long, baseline string, question string, answer string, truth string, sources string").coalesce(1)
    good = json.dumps({"scores": [{"criterion": "accuracy", "score": 9, "reasoning": "r"}, {"criterion": "depth", "score": "0"}]})
    got = {(r["question_id"], r["criterion"], r["score"], r["error"]) for r in answers.judged(df, Model(good, "no json")).collect()}
    assert {(1, "accuracy", 5, None), (1, "depth", 1, None)} <= got and any(i == 2 and e for i, _, _, e in got)


def test_providers():
    assert isinstance(providers.provider("Silent"), providers.Silent)
    with pytest.raises(ValueError):
        providers.provider("none")
    calls, slept = [], []

    def call(texts):
        calls.append(len(texts))
        if len(calls) == 1:
            raise OSError
        return [[float(len(t))] for t in texts]

    assert providers.in_batches(["a"] * 250, call, wait=slept.append) == [[1.0]] * 250 and calls == [100, 100, 100, 50] and slept == [1.0]
    one_by_one = [providers.hashed_embedding(t, 8) for t in ("a b a", "", "c")]
    assert providers.hashed_embeddings(["a b a", "", "c"], 8).tolist() == one_by_one


def test_questions_through_the_graph(spark):
    text = "1. Scope\nNBFC lenders shall file returns within 30 days and must keep records.\n2. Limits\nExposure of 10 % or 5 crore."
    recs = spark.createDataFrame([(1, "rbi", "KYC norms", "10-01-2024", "l1", "RBI/2024-25/1", text, "", "f"), (2, "sebi", "Brokers", "", "l2", "SEBI/2024-25/2", "Stock brokers must register. " * 5, "", "g")], "id long, source string, title string, date string, link string, number string, content string, details string, file_name string")
    stored = assistant.index(recs)
    stored = spark.createDataFrame(stored.collect(), stored.schema)
    plan = assistant.planned(spark, "Explain RBI/2024-25/1")
    assert plan.analysis and plan.number == "RBI/2024-25/1"
    whole = assistant.ask(stored, plan).orderBy("rank").collect()
    assert [r["chunk_index"] for r in whole] == list(range(len(whole))) and {r["number"] for r in whole} == {"RBI/2024-25/1"}
    gone = assistant.planned(spark, "Explain RBI/2024-25/77")
    assert gone.analysis and {r["source"] for r in assistant.ask(stored, gone).collect()} <= {"rbi", "sebi"}
    several = assistant.planned(spark, "Which norms for brokers?", model=Model("Which norms?", '["Which norms?", "brokers register", "third"]'), several=True)
    assert several.phrasings == ("Which norms?", "brokers register", "third")
    hits = assistant.ask(stored, several)
    assert hits.count() == hits.select(F.substring("text", 1, 100)).distinct().count() > 0
    nodes = spark.createDataFrame([("RBI/2024-25/1", "2024-01-10", "rbi", "KYC norms"), ("RBI/2025-26/9", "2025-02-01", "rbi", "New norms")], "node string, date string, source string, title string")
    edge = lambda *rows: spark.createDataFrame(list(rows), "src string, dst string")
    edges = {"supersedes": edge(("RBI/2025-26/9", "RBI/2024-25/1")), "about": edge(("RBI/2024-25/1", "KYC")), "applies_to": edge(("RBI/2024-25/1", "NBFC")), "amends": edge()}
    model = Model("the answer")
    plan = assistant.planned(spark, "What is the latest version of RBI/2024-25/1 and of all that it says on returns of lenders?")
    got = assistant.answer(assistant.ask(stored, plan), plan, model, nodes, edges)
    assert got["answer"] == "the answer" and "Latest version: RBI/2025-26/9 — New norms" in model.asked[0] and got["sources"]
    noted = answers.annotated(assistant.ask(stored, plan), "number", edges["supersedes"]).collect()
    assert {r["freshness_note"] for r in noted} == {"Superseded by RBI/2025-26/9"}
    assert answers.graph_lines("chain", nodes, edges).count() == 0 == answers.graph_lines("chain", nodes, edges, "X").count()
    assert answers.topic_named("kyc of banks", {"KYC": ("kyc", "aml"), "B": ("banks",)}) == "KYC" and answers.topic_named("x", {"A": ("y",)}) is None
    assert answers.source_named("rules of SEBI and RBI") == "rbi"
    empty = assistant.answer(assistant.ask(stored, plan).limit(0), plan, model)
    assert empty["chunks"] == 0


def test_edges_of_obligations(spark):
    schema = "extraction struct<circular_reference:string,supersedes:array<struct<circular_reference:string>>,amendments_to:array<struct<regulation_name:string>>,applies_to:array<struct<entity_type:string>>>"
    df = spark.createDataFrame([(("A", [("B",), ("",)], [("Act",)], [("Bank",), ("Bank",)]),), ((None, [("C",)], [], []),)], schema)
    got = {k: {tuple(r) for r in v.collect()} for k, v in graph.from_obligations(df).items()}
    assert got == {"supersedes": {("A", "B")}, "amends": {("A", "Act")}, "applies_to": {("A", "Bank")}}


def test_text_functions_without_a_query(spark):
    df = spark.range(1)
    of = lambda c: one(df, c.alias("x"))["x"]
    assert of(T.sanitized(F.lit("RBI/2023-24 (1)"))) == "RBI/2023-24 (1)" and of(T.sanitized(F.lit("a;b"))) == "" == of(T.sanitized(F.lit("a" * 51)))
    assert of(T.normalize_topic(F.lit("  Regarding Circular on  kyc norms"))) == "Kyc Norms" and of(T.normalize_topic(F.lit("re: kyc/aml  o'brien élan"))) == "Kyc/Aml O'Brien Élan"
    assert of(T.topic_label(F.lit("2.1 Scope Of It"), F.lit("x"))) == "scope of it" and of(T.topic_label(F.lit(""), F.lit("First one. Second"))) == "first one."
    assert of(T.embedding_text(F.lit("rbi"), F.lit("T" * 120), F.lit(""), F.lit("H"), F.lit("rule"), F.lit("sum"), F.lit("body"))) == f"[RBI | {'T' * 100} | Section: H | Type: rule]\nsum\nbody"
    assert of(N.bare_title(F.lit("1/24 - On x 5-1-24"), F.lit("1/24"), F.lit("5-1-24"))) == "On x"
    hits = spark.createDataFrame([(2, "b", "t", 0.5, "y"), (1, "a", "s", 0.75, "x")], "rank int, source string, title string, score double, text string")
    assert retrieval.context_block(hits).first()["context"] == "[1] a | s | Relevance: 0.75\nx\n\n---\n\n[2] b | t | Relevance: 0.50\ny"


def test_markdown_and_long_direction_parts(spark):
    text = "---\nk: v\n---\n" + "intro " * 20 + "\n## First\n" + "a " * 1200 + "\n## Second\nb"
    got = [(r["part"], r["title"]) for r in sections.split_parts(spark.createDataFrame([(1, text)], "doc_id long, text string"), "markdown").orderBy("pos").collect()]
    assert got == [("0", "Overview"), ("1", "First"), ("2", "Second")]
    body = "Chapter I - First\nlead\nA. Alpha part\n" + "x" * 5000 + "\nB. Beta part\n" + "y" * 5000
    got = [(r["part"], r["title"]) for r in sections.split_parts(spark.createDataFrame([(1, body)], "doc_id long, text string"), "direction").orderBy("pos").collect()]
    assert got == [("Chapter I (A)", "Alpha part"), ("Chapter I (B)", "Beta part")]


@pytest.mark.parametrize("seed", range(30))
def test_sentences_are_packed_as_a_plain_loop_would(seed):
    import random

    rng = random.Random(seed)
    sizes = [rng.choice([1, 3, 8, 20, 200]) for _ in range(rng.randint(0, 60))]
    least, most, overlap = 30, 60, 10
    want, now, fresh = [], [], False

    def total(ids):
        return sum(sizes[i] for i in ids)

    for i, n in enumerate(sizes):  # one sentence at a time
        if n > most:
            want += ([(now[0], now[-1] + 1)] if fresh else []) + [(i, i + 1)]
            now, fresh = [], False
            continue
        if now and total([*now, i]) > most and total(now) >= least:
            want.append((now[0], now[-1] + 1))
            while now and total(now) > overlap:
                now = now[1:]
        now, fresh = [*now, i], True
    want += [(now[0], now[-1] + 1)] if fresh else []
    assert sections.pack_sentences(sizes, 50, least, most, overlap) == want


# ---- further extractions --------------------------------------------------------------------------


def test_reextraction_sets_every_column(spark):
    columns = "extraction_status string, extraction_method string, extraction_error string, extraction_attempts long, extraction_timestamp string, content_length long, content_hash string, updated_at string"
    old = ("failed", "a", "e", None, "t0", 0, "", "t0")
    stored = spark.createDataFrame([(1, "x", *old, "kept"), (2, "y", *old, "kept"), (3, "z", *old, "kept"), (None, "n", *old, "kept")], f"id long, content string, {columns}, `other.column` string")
    tried = [(1, "first", "m1", None, 1), (1, "last é", "m2", None, 2), (2, None, None, "broke", 1), (None, "lost", "m", None, 1), (9, "new", "m", None, 1)]
    out = records.reextracted(stored, spark.createDataFrame(tried, "id long, content string, method string, error string, pos int"), "id", "pos", F.lit("t1"))
    assert out.columns == stored.columns
    digest = hashlib.sha256("last é".encode()).hexdigest()
    assert {r["id"]: tuple(r)[1:] for r in out.collect()} == {
        1: ("last é", "success", "m2", "", 2, "t1", 6, digest, "t1", "kept"), 2: ("", "failed", "", "broke", 1, "t1", 0, "", "t1", "kept"),
        3: ("z", *old, "kept"), None: ("n", *old, "kept"),
    }
    assert records.reextracted(stored, spark.createDataFrame([], "id long, content string, method string, error string, pos int"), "id", "pos", F.lit("t1")).collect() == stored.collect()


# ---- numbers and letters that only look like it ---------------------------------------------------


def test_a_number_that_holds_the_years_digits_gets_its_year(spark):
    pairs = [("2024", "2024"), ("12024", "2024"), ("20240/24", "2024"), ("7/2023-24", "2023-24"), ("7/2024", "2024"), ("5", "2.24"), ("5/2024", "2.24"), ("", "2024"), ("5", ""), (None, "2024"), ("5", None)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, number string, year string")
    got = [r[0] for r in rows.orderBy("i").select(N.trade_number(F.col("number"), F.col("year"))).collect()]
    assert got == ["2024/2024", "12024/2024", "20240/24/2024", "7/2023-24", "7/2024", "5/2.24", "5/2024/2.24", "2024", "5", None, "5"]


def test_prose_that_begins_with_a_letter_is_no_lettered_part(spark):
    def parts(*letters):
        text = "Chapter I - First\n" + "\n".join(f"{x}. Words of a line\n" + "x" * 5000 for x in letters)
        rows = sections.split_parts(spark.createDataFrame([(1, text)], "doc_id long, text string"), "direction").orderBy("pos").collect()
        return [(r["part"], r["content"].count("x")) for r in rows]

    assert parts("A", "A") == parts("Y", "A") == parts("A", "C") == [("Chapter I", 10000)]
    assert parts("A", "A", "B") == [("Chapter I (A)", 10000), ("Chapter I (B)", 5000)]
    assert parts("Y", "C", "D", "A") == [("Chapter I (C)", 5000), ("Chapter I (D)", 10000)]
