"""Spans in linear time, and the scores that SQL computes from trained models."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from quarry.functions import spans
from quarry.llm import pii, secrets, urls


def test_running_merges(spark):
    rng = random.Random(1)
    for n in (0, 1, 127, 128, 129, 1000):
        values = [rng.randint(0, 9) for _ in range(n)]
        df = spark.createDataFrame([(values,)], "v array<int>").withColumnRenamed("v", "w")
        got = df.select(F.expr(spans.running("w", "0", "{0} + {1}")).alias("s"), F.expr(spans.running("w", "0", "greatest({0}, {1})")).alias("m")).first()
        assert got["s"] == np.cumsum(values).tolist() and got["m"] == list(np.maximum.accumulate(values).tolist() if n else [])


def test_matches_equal_a_plain_search(spark):
    texts = ["", "abc", "12", "a1b22c333", "1 2 3", "é1😀22", "x" * 50 + "7" + "y" * 50, "12ab34"] + ["".join(random.Random(i).choice("a1 é") for _ in range(400)) for i in range(5)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for r in df.select("i", F.expr(spans.matches("text", "[0-9]++", 3)).alias("m")).collect():
        text, end = texts[r["i"]], 0
        want = []
        for m in re.finditer("[0-9]+", text):
            want.append((m.start(), m.end(), m[0], text[end : m.start()][-3:], text[m.end() : m.end() + 1]))
            end = m.end()
        assert [tuple(x) for x in r["m"]] == want


def test_spans_apart_equal_brute_force(spark):
    rng = random.Random(2)
    draw = lambda n: sorted({(a := rng.randint(0, 3000)): a + rng.randint(1, 12) for _ in range(n)}.items())
    for n, k in ((0, 5), (5, 0), (1, 1), (300, 200)):
        one, other = draw(n), draw(k)
        df = spark.createDataFrame([(one, other)], "one array<struct<start:int,end:int>>, other array<struct<start:int,end:int>>")
        got = {tuple(x) for x in df.select(F.expr(spans.apart("one", "other"))).first()[0]}
        assert got == {x for x in one if not any(y[0] < x[1] and x[0] < y[1] for y in other)}


def test_very_long_texts_rich_in_matches(spark):
    text = " ".join(f"user{i}@host.example.org 2001:db8::{i % 9999:x}:1:1:1 555-010-{i % 10000:04d}" for i in range(70_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = pii.find(df).select(F.size(F.expr("filter(base, m -> m.kind = 'email')")).alias("n"), F.size("spans").alias("all")).first()
    assert found["n"] == 70_000 and found["all"] >= 70_000
    text = " ".join(f"{i:032x}" for i in range(100_000))
    assert secrets.candidates(spark.createDataFrame([(1, text)], "doc_id long, text string")).count() == 100_000


def walk(tree: tuple, row: dict) -> float:
    while len(tree) > 1:
        f, limit, low, high = tree
        tree = low if row[list(secrets.FEATURES)[f]] <= limit else high
    return tree[0]


def test_forest_in_sql_equals_its_trees(spark):
    forest = secrets.train(secrets.synthetic_findings(spark, 600))
    scored = secrets.candidates(secrets.synthetic_findings(spark, 200, seed=5), ("finding",)).withColumn("score", F.expr(secrets.score_sql(forest))).collect()
    assert scored and any(len(t) > 1 for t in forest)
    for r in scored:
        assert r["score"] == pytest.approx(sum(walk(t, r.asDict()) for t in forest) / len(forest))


def test_candidates_equal_a_plain_search(spark, data):
    extra = ['password = "hunter2!"', "db_pwd: pa$$w0rd and more", "no password here", "token=<x> TOKEN: 'a.b,c;d'", None, "", "api_key=" + "k" * 300]
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    got = sorted((r["doc_id"], r["start"], r["end"]) for r in secrets.candidates(docs).collect())
    pattern = regex.compile(secrets.CANDIDATE)
    assert got == sorted((r["doc_id"], m.start(), m.end()) for r in docs.collect() for m in pattern.finditer(r["text"] or ""))
    assert {-1, -2, -7} <= {i for i, _, _ in got} and not {-3, -5, -6} & {i for i, _, _ in got}


def test_passwords_are_told_from_placeholders(spark):
    forest = secrets.train(secrets.synthetic_findings(spark))
    rows = [(1, 'password = "Tion7#4412x"'), (2, "db_password: Entes!203$x"), (3, "the password: something"), (4, "token = changeme"), (5, 'passwd="${TOKEN}"')]
    found = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), forest)
    assert {r["doc_id"] for r in found.where("secret").collect()} == {1, 2}


def test_span_logits_in_sql_equal_the_model(spark):
    texts = ["write to me [at] no: jane (at) mail.org", "login from fe80:0:0:1:2", "call 555-010-2000 or tel. (212) 555 0100", "card 4000 1234 5678 9012", "order 1234 5678 9012 3456"]
    found = pii.candidates(spark.createDataFrame(list(enumerate(texts * 3)), "doc_id long, text string"))
    votes = found.select(F.explode("votes").alias("m"))
    counts = votes.select("m.*").groupBy("kind", "strict", *pii.FEATURES).agg(F.count("*").alias("n")).collect()
    models = pii.train(counts)
    rows = votes.select("m", F.expr(pii._logit(models)).alias("z")).collect()
    assert rows
    for r in rows:
        model = models[r["m"]["kind"]]
        text = lambda v: str(v).lower() if isinstance(v, bool) else str(v)
        want = model["intercept"] + sum(model["weights"].get((f, text(r["m"][f])), 0.0) for f in pii.FEATURES)
        assert r["z"] == pytest.approx(want)


def test_urls_keep_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "http://a.org/x", 7)], "page_id long, url string, v int")
    names = ["best", "_url", "key", "c0", "rule_host", "a.b", "prefix", "rule", "host"]
    df = df.select("page_id", "url", *(F.col("v").alias(n) for n in names))
    rules = spark.createDataFrame([("block", "org", "/x")], "action string, host string, path string")
    out = urls.judge(df, rules)
    assert out.columns == ["page_id", "url", *(n for n in names if n not in ("rule", "host")), "host", "path", "rule", "verdict"]
    r = out.first()
    assert (r["best"], r["_url"], r["host"], r["rule"], r["verdict"]) == (7, 7, "a.org", "org/x", "block")
