"""Fill-in-middle against a plain loop over characters, and round trips of awkward texts."""

from __future__ import annotations

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import infilling

TEXTS = [
    None, "", " ", "a", "ab cd", "<P> in a text", "a <S>", "<M>", "<", "<P", "P>", "S><M", "a<P b>c", "é ü 😀 ß\u0000x", "two\r\nlines\n\n", "123 456", "word " * 60_000, "x" * 200_000, ". " * 50_000,
    "<<S", "ends in <S", "<|endoftext|>",
]


def plain(name, text, rate=90, spm=20, seed="1"):
    """(n, form, prefix_chars, middle_chars, output) character by character."""
    units, last = [], False
    for c in text or "":
        letter = c.isascii() and c.isalpha()
        if letter and last:
            units[-1] += c
        else:
            units.append(c)
        last = letter
    n, digest = len(units), hashlib.sha256(f"{seed}:{'' if name is None else name}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text or ""
    a, b = min(h[0] % (n + 1), h[1] % (n + 1)), max(h[0] % (n + 1), h[1] % (n + 1))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m
    return n, "psm", len(p), len(m), "<P>" + p + "<S>" + s + "<M>" + m


def test_equals_a_plain_loop(spark):
    rows = [(i, t) for i in (1, 2, 3, 7, 90, 12_345_678_901, -4, None) for t in TEXTS] + [(1, "ab cd")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit(1), "form": F.lit("x"), "a.b": F.lit(2), "output": F.lit(3), "made": F.lit(4)})
    got = infilling.fill_in_middle(df).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    assert sorted(map(tuple, got), key=key) == sorted([(i, *plain(i, t)) for i, t in rows], key=key)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert sorted(infilling.restored(r["output"], r["form"]) for r in got) == sorted(t or "" for _, t in rows)


def test_parameters(spark):
    rows = [(i, f"text number {i} of some") for i in range(60)]
    df = spark.createDataFrame(rows, "`the id` long, body string")
    got = sorted(map(tuple, infilling.fill_in_middle(df, "other", 100, 100, "the id", "body").collect()))
    assert got == [(i, *plain(i, t, 100, 100, "other")) for i, t in rows] and {r[2] for r in got} == {"spm"}
    assert {r["form"] for r in infilling.fill_in_middle(df, rate=0, id_col="the id", text_col="body").collect()} == {"plain"}


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**6), st.one_of(st.text(alphabet="<>PSM ab", max_size=30), st.text(max_size=60)))
def test_round_trip(name, text):
    n, form, prefix, middle, output = infilling.one(str(name), text, "1", 100, 50)
    assert infilling.restored(output, form) == text
    assert (n, form, prefix, middle, output) == plain(name, text, 100, 50)


def test_query_digests_and_no_text_comes_back(spark, data):
    got = infilling.op13_infilling(spark, data)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in got.collect():
        n, form, prefix, middle, output = plain(r["doc_id"], texts[r["doc_id"]])
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert tuple(r) == (r["doc_id"], n, form, prefix, middle, digest(output), digest(texts[r["doc_id"]]))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan


def test_nothing_and_wrong_output(spark):
    assert infilling.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError):
        infilling.restored("no mark", "psm")
