"""Field logic of the site connectors, as columns over rows already cut from pages or responses.

Fetching, browsers and back-off are a transport's; what a row of a listing means is here.  Every function
takes and returns DataFrames or Columns; rows that cannot make a record are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: tax types and the months of written dates
TAX_TYPES = {1000001: "GST", 1000002: "Customs", 1000003: "Central Excise", 1000004: "Service Tax"}
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def gazette_url(gazette_id: Column, base: str) -> Column:
    """PDF of a gazette: year and number from the last two parts of its id; else empty."""
    parts = F.split(gazette_id, "-")
    year = F.substring(F.element_at(parts, -2), -4, 4)
    good = (F.size(parts) >= 3) & year.rlike("^[0-9]{4}$") & (F.element_at(parts, -1) != "")
    return F.when(good, F.concat(F.lit(f"{base}/WriteReadData/"), year, F.lit("/"), F.element_at(parts, -1), F.lit(".pdf"))).otherwise("")


def gazettes(rows: DataFrame, kind: str, base: str) -> DataFrame:
    """Records of rows with exactly ten cells and a gazette id."""
    c = lambda i: F.trim(F.col("cells")[i])
    rows = rows.where((F.size("cells") >= 10) & (F.trim(F.col("cells")[8]) != ""))
    names = {"ministry": 1, "dept": 2, "office": 3, "part_section": 5, "issue_date": 6, "publish_date": 7, "gazette_id": 8, "file_size": 9}
    return rows.select(F.lit(f"eGazette ({kind})").alias("source"), c(4).alias("title"), c(7).alias("date"), c(1).alias("department"), gazette_url(c(8), base).alias("link"), *(c(i).alias(n) for n, i in names.items()))


def without_size(title: Column) -> Column:
    """A title without a file size at its end."""
    return F.trim(F.regexp_replace(title, r"\(\d+(?:\.\d+)?\s*[KMG]?B\)\s*$", ""))


def insolvency(rows: DataFrame, label: str, base: str) -> DataFrame:
    """Records of rows (cells, onclicks): date, subject and the PDFs of the click handlers."""
    pdfs = F.filter(F.transform("onclicks", lambda o: F.regexp_extract(o, r"(?i)newwindow1\(['\"]([^'\"]+\.pdf)['\"]", 1)), lambda u: u != "")
    urls = F.transform(pdfs, lambda u: F.when(u.startswith("http"), u).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.ltrim(u, F.lit("/")))))
    out = rows.where(F.size("cells") >= 3).select(without_size(F.col("cells")[2]).alias("title"), F.trim(F.col("cells")[1]).alias("date"), urls.alias("pdf_links"))
    link = F.when(F.size("pdf_links") > 0, F.get("pdf_links", F.lit(0))).otherwise(F.concat(F.lit(f"{base}/legal-framework/{label}/"), "date"))
    return out.where(F.length("title") >= 5).select(F.lit(f"IBBI ({label})").alias("source"), "title", "date", link.alias("link"), "pdf_links")


def trade_number(number: Column, year: Column) -> Column:
    """Number with its year, unless it has it: the year's digits within others, or a bare number that
    happens to be equal to it, are not its year."""
    own = F.concat(F.lit("(?<![0-9])"), F.regexp_replace(year, "[^0-9A-Za-z]", r"\\$0"), F.lit("(?![0-9])"))
    held = F.rlike(number, own) & ~number.rlike("^[0-9]+$")
    return F.when((year != "") & ~held, F.when(number != "", F.concat(number, F.lit("/"), year)).otherwise(year)).otherwise(number)


def trade(rows: DataFrame, label: str, base: str) -> DataFrame:
    """Records of rows (cells, links): number, year, description, date, attachment."""
    c = lambda i: F.trim(F.col("cells")[i])
    pdfs = F.filter("links", lambda u: F.contains(u, F.lit("content.dgft.gov.in")) | F.contains(F.lower(u), F.lit(".pdf")))
    title = F.when(c(3) != "", c(3)).otherwise(c(1))
    out = rows.where(F.size("cells") >= 5).select(title.alias("title"), c(4).alias("date"), trade_number(c(1), c(2)).alias("circular_number"), pdfs.alias("pdf_links")).where(F.length("title") >= 3)
    link = F.when(F.size("pdf_links") > 0, F.get("pdf_links", F.lit(0))).otherwise(F.concat(F.lit(f"{base}/CP/?opt={label}&num="), "circular_number"))
    return out.select(F.lit(f"DGFT ({label})").alias("source"), "title", "date", "circular_number", link.alias("link"), "pdf_links")


def accountants(rows: DataFrame, label: str) -> DataFrame:
    """Records of links (text, href): a date in brackets at the end of the text is cut off."""
    pattern = r"-\s*\((\d{2}-\d{2}-\d{4})\)\s*$"
    good = (F.length("text") >= 10) & ~F.lower("href").rlike("javascript:|mailto:|#")
    pdfs = F.when(F.contains(F.lower("href"), F.lit(".pdf")), F.array("href")).otherwise(F.array().cast("array<string>"))
    return rows.where(good).select(F.lit(f"ICAI ({label})").alias("source"), F.trim(F.regexp_replace("text", pattern, "")).alias("title"), F.regexp_extract("text", pattern, 1).alias("date"), F.col("href").alias("link"), pdfs.alias("pdf_links"))


def meeting_number(title: Column) -> Column:
    n = F.regexp_extract(title, r"(?i)(\d+)\s*(?:st|nd|rd|th)", 1)
    return F.when(n != "", F.concat(F.lit("GST-COUNCIL-"), n)).otherwise("")


def written_date(text: Column) -> Column:
    """yyyy-MM-dd of the first date written out, day or month first; else empty."""
    names = "|".join(MONTHS)
    first, second = rf"(?i)(\d{{1,2}})\s*(?:st|nd|rd|th)?\s+({names})\s+(\d{{4}})", rf"(?i)({names})\s+(\d{{1,2}}),?\s+(\d{{4}})"
    month = lambda name: F.lpad(F.array_position(F.array(*map(F.lit, MONTHS)), F.initcap(name)).cast("string"), 2, "0")
    part = lambda p, d, m: F.concat_ws("-", F.regexp_extract(text, p, 3), month(F.regexp_extract(text, p, m)), F.lpad(F.regexp_extract(text, p, d), 2, "0"))
    return F.when(text.rlike(first), part(first, 1, 2)).when(text.rlike(second), part(second, 2, 1)).otherwise("")


def council(rows: DataFrame) -> DataFrame:
    """Records of meetings (name, date_text, venue, agenda, minutes as arrays of url and text): one for
    each document, minutes first."""
    def of(column: str, kind: str, word: str) -> Column:
        title = lambda d: F.when(d["text"] != "", d["text"]).otherwise(F.concat(F.lit(f"{word} - "), F.col("name")))
        return F.transform(column, lambda d: F.struct(d["url"].alias("url"), title(d).alias("title"), F.lit(kind).alias("doc_type")))

    docs = F.concat(of("minutes", "Meeting Minutes", "Minutes"), of("agenda", "Agenda", "Agenda"))
    out = rows.select("name", "date_text", "venue", F.explode(docs).alias("d"))
    return out.select(F.lit("gst_council").alias("source"), F.col("d.title").alias("title"), written_date(F.col("date_text")).alias("date"), F.col("d.url").alias("link"), meeting_number(F.col("name")).alias("circular_number"), F.col("d.doc_type").alias("doc_type"), F.concat_ws(" | ", F.lit("GST Council"), "name", "venue").alias("details"))


def tax_documents(responses: DataFrame, kind: str, base: str) -> DataFrame:
    """Records of JSON items (body, tax_id, category) of a kind: circular, notification, order, instruction.

    Items without a name are dropped; paths get forward slashes, dates become dd-Mon-yyyy.
    """
    get = lambda f: F.coalesce(F.get_json_object("body", f"$.{f}"), F.lit(""))
    short = {"circular": "circular", "notification": "notification", "order": "order", "instruction": "instruction"}[kind]
    tax_id = F.coalesce(F.col("tax_id"), F.get_json_object("body", "$.tax.id").cast("int"))
    tax = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in TAX_TYPES.items() for x in kv)), tax_id), F.lit("Unknown"))
    path = F.trim(F.replace(get("docFilePath"), F.lit("\\"), F.lit("/")))
    name = F.coalesce(F.nullif(get(f"{short}Name"), F.lit("")), get(f"{short}NameToBeDisplay"))
    category = F.coalesce("category", get(f"{short}Category"))
    when = get(f"{short}Dt")
    date = F.coalesce(F.date_format(F.try_to_timestamp(when), "dd-MMM-yyyy"), when)
    link = F.when(path != "", F.concat(F.lit(f"{base}/content/pdf/"), path)).otherwise(F.concat(F.lit(f"{base}/view-pdf/"), get("id"), F.lit(f"/ENG/{kind.capitalize()}s")))
    out = responses.select(F.concat(F.lit("CBIC ("), tax, F.lit(")")).alias("source"), name.alias("title"), date.alias("date"), F.concat(F.lit("CBIC - "), tax).alias("department"), link.alias("link"), F.btrim(F.concat(get(f"{short}No"), F.lit(" | "), category), F.lit(" |")).alias("details"), get(f"{short}No").alias("circular_number"), F.lit(kind.capitalize()).alias("doc_type"))
    return out.where("title <> ''")


def nested_documents(responses: DataFrame) -> DataFrame:
    """Items of a JSON list that is a string within a JSON body (field documentDetails)."""
    item = "array<struct<docID:string,docName:string,docDate:string>>"
    return responses.select(F.explode(F.from_json(F.get_json_object("body", "$.documentDetails"), item)).alias("d")).select("d.*")


def more_pages(text: Column) -> Column:
    """Whether a listing that says "X to Y of Z" goes on."""
    pattern = r"(\d+)\s+to\s+(\d+)\s+of\s+(\d+)"
    n = lambda g: F.try_element_at(F.array(F.nullif(F.regexp_extract(text, pattern, g), F.lit(""))), F.lit(1)).cast("long")
    return F.coalesce(n(2) < n(3), F.lit(False))


def framed_pdf(src: Column) -> Column:
    """The file parameter of a viewer's address."""
    return F.nullif(F.regexp_extract(src, r"[?&]file=([^&]+)", 1), F.lit(""))


def detail_lines(text: Column) -> Column:
    """struct (number, date) of a detail page: the first line with a bank's number, and the first short
    line that begins with a month."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    number = F.get(F.filter(lines, lambda x: x.startswith("RBI/")), F.lit(0))
    months = "|".join(MONTHS)
    date = F.get(F.filter(lines, lambda x: x.rlike(f"^(?:{months})") & (F.length(x) < 30)), F.lit(0))
    return F.struct(number.alias("number"), date.alias("date"))


def date_cell(cells: Column) -> Column:
    """The first cell with a month's short name or a year after a slash; else empty."""
    months = "|".join(m[:3] for m in MONTHS)
    return F.coalesce(F.get(F.filter(cells, lambda c: c.rlike(f"{months}|/20|/19")), F.lit(0)), F.lit(""))


def bare_title(text: Column, number: Column, date: Column) -> Column:
    """A link's text without the number before and the date after it."""
    head = F.when(text.startswith(number) & (number != ""), F.substring(text, F.length(number) + 1, F.length(text))).otherwise(text)
    tail = F.when(F.endswith(head, date) & (date != ""), F.substring(head, F.lit(1), F.length(head) - F.length(date))).otherwise(head)
    return F.btrim(tail, F.lit(" -–|:"))


def preferred_content(html: Column, pdf: Column, factor: float = 1.5) -> Column:
    """The PDF's text if it is longer than the page's by a factor."""
    return F.when(F.length(pdf) > factor * F.length(html), pdf).otherwise(html)


def joined_pdfs(parts: Column) -> Column:
    """Texts of several PDFs (array of url and text) under a heading each; one stands alone."""
    some = F.filter(parts, lambda p: F.coalesce(p["text"], F.lit("")) != "")
    headed = F.transform(some, lambda p: F.concat(F.lit("--- PDF: "), p["url"], F.lit(" ---\n"), p["text"]))
    return F.when(F.size(some) > 1, F.array_join(headed, "\n\n")).otherwise(F.coalesce(F.get(some, F.lit(0))["text"], F.lit("")))


def merged_upload(parts: DataFrame, key: str) -> DataFrame:
    """One text for each upload: the original and its amendments, headed, in order of ``pos``."""
    title = F.when(F.col("pos") == 0, "Original").otherwise(F.concat(F.lit("Amendment "), F.col("pos").cast("string")))
    line = F.lit("=" * 20)
    block = F.concat_ws("\n", line, title, line, F.col("text"))
    return parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", block.alias("b")))).alias("p")).select(key, F.array_join("p.b", "\n\n").alias("text"))


def cached_first(documents: DataFrame, cache: DataFrame, keys: list[str], fetch: Column) -> DataFrame:
    """Bytes from the cache where it has them, else fetched."""
    return documents.join(cache.select(*keys, F.col("raw_bytes").alias("_c")), keys, "left").withColumn("raw_bytes", F.coalesce("_c", fetch)).drop("_c")


def synthetic_keys(parts: DataFrame, act: str) -> DataFrame:
    """Record number and link of legislation parts (part): CGST-S16, CGST_RULES-R89 and the like."""
    clean = F.regexp_replace("part", "[^a-zA-Z0-9]", "_")
    mark = "R" if act.endswith("_RULES") else "S"
    number = F.concat(F.lit(f"{act}-{mark}"), F.col("part"))
    return parts.withColumn("circular_number", number).withColumn("link", F.concat(F.lit(f"legislation://{act}/"), clean))


def bank_circulars(rows: DataFrame, base: str) -> DataFrame:
    """Records of a bank's listing (cells, href, html_text, pdf_text): the date is a cell of its own or of
    the detail page, the number comes from the detail page, and a PDF's text wins if it is longer."""
    detail = detail_lines(F.coalesce("html_text", F.lit("")))
    link = F.when(F.col("href").startswith("http"), F.col("href")).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.ltrim("href", F.lit("/"))))
    content = F.when(F.length(F.coalesce("pdf_text", F.lit(""))) > F.length(F.coalesce("html_text", F.lit(""))), F.col("pdf_text")).otherwise(F.coalesce("html_text", F.lit("")))
    date = F.coalesce(F.nullif(date_cell(F.col("cells")), F.lit("")), detail["date"], F.lit(""))
    longest = F.array_max(F.transform("cells", lambda c: F.struct(F.length(c).alias("n"), c.alias("c"))))["c"]
    out = rows.where((F.size("cells") > 0) & (F.coalesce("href", F.lit("")) != ""))
    return out.select(F.lit("rbi").alias("source"), F.trim(longest).alias("title"), date.alias("date"), F.coalesce(detail["number"], F.lit("")).alias("circular_number"), link.alias("link"), content.alias("content"))


def selective(records: DataFrame, seen: DataFrame, keep: Column, key: str = "link") -> DataFrame:
    """Of newly appended records (those whose key is not seen yet) the ones that a filter keeps."""
    return records.join(seen.select(key), key, "left_anti").where(keep)


def market_circulars(rows: DataFrame) -> DataFrame:
    """Records of a market regulator's pages (title, date, number_text, href, frame): the PDF is the file
    parameter of the page's frame; the number stands after a label."""
    number = F.trim(F.regexp_replace(F.coalesce("number_text", F.lit("")), r"(?i)^\s*circular\s+no\.?\s*:?", ""))
    pdf = framed_pdf(F.coalesce("frame", F.lit("")))
    pdfs = F.when(pdf.isNotNull(), F.array(pdf)).otherwise(F.array().cast("array<string>"))
    return rows.where(F.length(F.trim("title")) > 0).select(F.lit("sebi").alias("source"), F.trim("title").alias("title"), F.trim("date").alias("date"), number.alias("circular_number"), F.col("href").alias("link"), pdfs.alias("pdf_links"))


def pages_until_end(pages: DataFrame, text: str = "text", page: str = "page", most_failures: int = 3) -> DataFrame:
    """Pages of a listing up to the one that says it is the last, or the failure after which it is given up.

    A page without a text has failed.  One listing: its pages are few.
    """
    w = Window.orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    failed = F.coalesce(F.col(text), F.lit("")) == ""
    marked = pages.withColumn("_end", (~failed & ~more_pages(F.coalesce(text, F.lit("")))).cast("int")).withColumn("_ok", F.sum((~failed).cast("int")).over(Window.orderBy(page)))
    marked = marked.withColumn("_streak", F.sum(failed.cast("int")).over(Window.partitionBy("_ok").orderBy(page)))
    stop = F.coalesce(F.max(F.greatest(F.col("_end"), (F.col("_streak") >= most_failures).cast("int"))).over(w), F.lit(0))
    return marked.withColumn("_stop", stop).where("_stop = 0").drop("_end", "_ok", "_streak", "_stop")


def company_circulars(responses: DataFrame, base: str) -> DataFrame:
    """Records of a ministry's responses (a JSON list within JSON): the link has the document's quoted id."""
    d = nested_documents(responses)
    link = F.concat(F.lit(f"{base}/content/dms?doc="), F.url_encode("docID"))
    return d.where(F.coalesce(F.trim("docName"), F.lit("")) != "").select(F.lit("mca").alias("source"), F.trim("docName").alias("title"), F.coalesce(F.trim("docDate"), F.lit("")).alias("date"), link.alias("link"))


def insurer_circulars(pages: DataFrame) -> DataFrame:
    """Records of a looping listing (page, pos, title, date, link, archived): it ends at the first page
    without a link that was not seen on an earlier one; each link counts once."""
    first = pages.groupBy("link").agg(F.min(F.struct("page", "pos")).alias("f"))
    kept = pages.join(first, "link").where("f.page = page and f.pos = pos").drop("f")
    fresh = pages.select("page").distinct().join(kept.select("page").distinct().withColumn("_new", F.lit(True)), "page", "left")
    end = fresh.where("_new is null").agg(F.min("page").alias("_end"))  # one row
    out = kept.crossJoin(F.broadcast(end)).where("_end is null or page < _end")
    status = F.when(F.col("archived"), "archived").otherwise("current")
    return out.select(F.lit("irdai").alias("source"), F.trim("title").alias("title"), F.trim("date").alias("date"), "link", status.alias("archive_status"))


def years_to_visit(found: int, years: list[int]) -> list[int]:
    """Years that must be asked for one by one: those, if the view of all shows 1 to 30 records."""
    return years if 0 < found <= 30 else []


def direct_tax_circulars(rows: DataFrame) -> DataFrame:
    """Records of a direct-tax listing (text, number, date, link, pos): the title is the text without them;
    each link counts once in a session."""
    w = Window.partitionBy("link").orderBy("pos")
    one = rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    title = bare_title(F.trim("text"), F.coalesce("number", F.lit("")), F.coalesce("date", F.lit("")))
    return one.select(F.lit("cbdt").alias("source"), title.alias("title"), F.coalesce("date", F.lit("")).alias("date"), F.coalesce("number", F.lit("")).alias("circular_number"), "link").where(F.length("title") > 0)


def practitioner_keys(parts: DataFrame) -> DataFrame:
    """Record number and link of notes' sections (file, part): PKB-<file>-S<part>."""
    name = F.upper(F.regexp_replace(F.regexp_replace("file", r"\.md$", ""), "[^a-zA-Z0-9]", "_"))
    number = F.concat(F.lit("PKB-"), F.substring(name, 1, 40), F.lit("-S"), F.col("part"))
    return parts.withColumn("circular_number", number).withColumn("link", F.concat(F.lit("practitioner://"), number))


def direction_keys(parts: DataFrame) -> DataFrame:
    """Record number and link of a direction's chapters (name, part, url): RBI_MD-<name>-<part>."""
    clean = lambda c, n: F.substring(F.regexp_replace(c, "[^a-zA-Z0-9]", "_"), 1, n)
    return parts.withColumn("circular_number", F.concat(F.lit("RBI_MD-"), clean("name", 40), F.lit("-"), clean("part", 20))).withColumn("link", F.concat("url", F.lit("#"), clean("part", 20)))


def best_content(html: Column, pdfs: Column, factor: float = 1.5) -> Column:
    """A page's text, or that of its first two PDFs if it is longer by a factor."""
    return preferred_content(html, joined_pdfs(F.slice(pdfs, 1, 2)), factor)
