"""Exact expectations for text, date and importance functions."""

import re

import pytest
from pyspark.sql import functions as F

from quarry.functions import fixed_values as V
from quarry.functions import text as T

YEARS = [
    ("", "Mar 04, 2026", "", 2026), ("", "10-01-2026", "", 2026), ("", "02.03.2026", "", 2026), ("", "15/06/2023", "", 2023), ("", "10-Jan-2022", "", 2022), ("", "January 15, 2021", "", 2021),
    ("", "2024-06-15", "", 2024), ("", "", "", None), (None, None, None, None), ("RBI/2025-2026/225", "", "", 2026), ("RBI/2023-2024/100 - Some circular", None, None, 2024),
    ("", "", "SLR | 02.3.2026 | text", 2026), ("", "", "Ref: 15.12.2019 circular", 2019), ("Guidelines for 2022 fiscal year", "", "", 2022),
]
KEEPS = [
    ("Master Direction on KYC", "", "", True), ("Master Circular on NPA", "", "", True), ("master direction - updated", "Mar 04, 2025", "", True), ("Amendment to NPA norms", "", "", True),
    ("Modified guidelines on lending", "", "", True), ("Revised framework for ECB", "Mar 04, 2025", "", True), ("NPA classification norms", "Jan 15, 2022", "", True), ("KYC guidelines update", "Jun 10, 2020", "", True),
    ("NBFC registration rules", "Mar 01, 2023", "", True), ("Digital lending framework", "Aug 15, 2021", "", True), ("Priority sector lending", "Jan 01, 2019", "", True), ("Staff memo on office timing", "Jan 15, 2022", "", False),
    ("Holiday list for 2023", "Dec 01, 2022", "", False), ("Routine circular about reporting", "Mar 04, 2025", "", False), ("NPA classification norms", "Jun 15, 2024", "", False), ("Master Direction on digital lending", "Mar 04, 2025", "", True),
    ("NPA classification norms", "", "", True), ("Basel III implementation", None, None, True), ("General office circular", "", "", False), ("Routine notice to staff", "", "", False),
    ("Circular 123", "", "NPA norms | 15.6.2022", True), ("Circular 123", "", "Office memo | 15.6.2022", False),
]


def test_years_and_importance(spark):
    c = [F.col(x) for x in ("title", "date", "details")]
    rows = [(i, *r[:3]) for i, r in enumerate(YEARS + KEEPS)]
    out = spark.createDataFrame(rows, "i int, title string, date string, details string").select("i", T.record_year(*c).alias("y"), T.is_important(*c).alias("k")).orderBy("i").collect()
    assert [r["y"] for r in out[: len(YEARS)]] == [y[3] for y in YEARS]
    assert [r["k"] for r in out[len(YEARS) :]] == [k[3] for k in KEEPS]


@pytest.mark.parametrize(
    ("text", "start", "end", "want"),
    [("a START b END c", "START", "END", "START b END"), ("x END", "START", "END", "x END"), ("START x", "START", "END", "START x"), ("END x START", "START", "END", "END x START")],
)
def test_excerpt(spark, text, start, end, want):
    row = spark.createDataFrame([(text, start, end)], "t string, s string, e string").select(T.excerpt(F.col("t"), F.col("s"), F.col("e")))
    assert row.first()[0] == want


@pytest.mark.parametrize(("raw", "ok"), [('[{"title": "a"}]', True), ('```json\n[{"title": "a"}]\n```', True), ("not json", False), ('{"title": "a"}', False), ("[]", False)])
def test_topics_json(spark, raw, ok):
    assert (spark.createDataFrame([(raw,)], "r string").select(T.topics_json(F.col("r"))).first()[0] is not None) == ok


def test_sentences_and_tables(spark):
    df = spark.createDataFrame([("One. Two went.\n\nThree! four", [["A", None, ""], ["1", "x\ny", ""], [None, None, None]])], "t string, r array<array<string>>")
    row = df.select(T.sentences(F.col("t")).alias("s"), T.table_markdown(F.col("r")).alias("m")).first()
    assert row["s"] == ["One.", "Two went.", "\n\nThree! four"]
    assert row["m"] == "| A |  |\n| --- | --- |\n| 1 | x y |"


def test_a_pattern_is_tried_only_where_its_word_is_and_finds_the_same(spark):
    assert [T._needed(p) for p in (r"shall\s+(?:file|submit)", r"\d+\s*%", r'"[^"]+"\s+means', r"a|bcd", r"(?i)word", r"words?x", r"\bmust\b")] == ["shall", None, "means", None, None, None, "must"]
    bodies = ["It shall FILE; shall not", "5 % and 7 crore", "Rs 5 lakh", '"A" means b; "C" shall mean d', "applies  to all", "notwithstanding", "within 7 days", "must be mandatory", "step 4", "Step x", "marshall musty", "", None]
    rows = spark.createDataFrame([(i, h, b) for i, b in enumerate(bodies) for h in ("x", "Scope")], "i int, h string, b string")
    got = {(r["i"], r["h"]): r["k"] for r in rows.select("i", "h", T.section_type(F.col("h"), F.col("b")).alias("k")).collect()}
    for (i, h), kind in got.items():
        body, want = bodies[i], "general"
        for name, words, patterns, least in V.SECTION_TYPES:
            if any(w in h.lower() for w in words) or (body is not None and sum(bool(re.search(p, body.lower())) for p in patterns) >= least):
                want = name
                break
        assert kind == want, (h, body)
