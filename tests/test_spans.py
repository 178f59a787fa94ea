"""Spans of patterns against Python's re, by themselves: superseded() rests on them."""

import re

from pyspark.sql import functions as F

from quarry.functions.spans import matches

TEXTS = ["", "abc", "a1 b22 c333", "1", "é1 😀22 x", "12" * 300, "no digits", None, " 7"]


def test_matches_equal_re(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string").where(F.col("text").isNotNull())
    for pattern in ("[0-9]+", "[a-z][0-9]", "x"):
        got = {r["i"]: [(m["start"], m["end"], m["s"]) for m in r["m"]] for r in df.select("i", F.expr(matches("text", pattern, 1)).alias("m")).collect()}
        assert got == {i: [(m.start(), m.end(), m[0]) for m in re.finditer(pattern, t)] for i, t in enumerate(TEXTS) if t is not None}
