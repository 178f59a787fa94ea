"""Hard-negative mining against plain loops over integers of any size."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import negatives

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
SCHEMA = "vec_id long, label int, embedding array<double>"


def brute(rows, every=50, positives=5, k=3, low=50, high=95, scale=256.0):
    part = sorted({(i, y, tuple(math.floor(scale * c) for c in v)) for i, y, v in rows if i is not None and y is not None and v and all(c is not None and math.isfinite(c) for c in v)})
    out = []
    for i, y, v in part:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, z) for j, z, w in part if len(w) == len(v) and (j != i or z != y))
        for s, j, _ in [x for x in scored if x[2] == y][:positives]:
            inside = [(-t, m) for t, m, z in scored if z != y and low * -s <= 100 * -t <= high * -s][:k]
            out += [(i, j, r + 1, m, -s, t) for r, (t, m) in enumerate(inside)]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r[c] for c in COLUMNS) for r in negatives.mine(df, **options).collect())


def vectors(n, dim, labels, seed, spread=0.7):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dim))
    y = rng.integers(0, labels, n)
    x = centres[y] + spread * rng.normal(size=(n, dim))
    return [(i, int(rng.integers(0, labels)) if i % 3 == 0 else int(y[i]), x[i].tolist()) for i in range(n)]


def test_equals_brute_force_in_many_blocks_and_groups(spark, monkeypatch):
    monkeypatch.setattr(negatives, "LEAST", 16)
    monkeypatch.setattr(negatives, "GROUP", 5)
    monkeypatch.setattr(negatives, "TABLES", 2)
    monkeypatch.setattr(negatives, "PAIRS", 7)
    rows = vectors(300, 7, 4, 1)
    got = mined(spark, rows, anchors="vec_id % 20 = 0")
    assert got == brute(rows, 20) and len(got) > 100


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 0.5]), (0, 1, [1.0, 0.5]),  # a repeated row counts once
        (0, 2, [0.9, 0.1]),  # shares the anchor's id: a row of its own
        (1, 1, [0.9, 0.5]), (2, 1, [0.9, 0.5]), (3, 1, [-1.0, 0.0]), (4, 1, [0.0, 0.0]),  # ties, negative and zero scores
        (5, 2, [0.7, 0.4]), (6, 2, [0.7, 0.4]), (7, 3, [0.6, 0.3]), (8, 3, [0.0, 0.0]), (9, 4, [-0.6, 0.0]),
        (None, 1, [1.0, 1.0]), (10, None, [1.0, 1.0]), (11, 1, None), (12, 1, []), (13, 1, [1.0, None]), (14, 1, [nan, 1.0]), (15, 1, [1.0, -inf]),
        (16, 1, [1.0, 0.5, 0.1]), (50, 2, [1.0, 0.4, 0.3]), (51, 2, [1.0, 0.4, 0.2]), (52, 1, [0.8, 0.3, 0.2]),  # another length
        (100, 9, [1.0]),  # an anchor with no other row of its length
    ]
    got = mined(spark, rows)
    assert got == brute(rows) and {r[0] for r in got} == {0, 50}


def test_one_label_and_equal_vectors(spark):
    same = [(i, 1, [0.5, 0.25]) for i in range(200)]
    assert mined(spark, same) == []
    rows = [(i, i % 2, [0.5, 0.25]) for i in range(120)] + [(200 + i, i % 2, [0.25, 0.2]) for i in range(40)]
    assert mined(spark, rows) == brute(rows)


def test_large_components(spark):
    rng = random.Random(3)
    rows = [(i, i % 3, [rng.uniform(-40_000, 40_000) for _ in range(3)]) for i in range(160)]
    assert mined(spark, rows) == brute(rows)


def test_other_parameters_and_columns_of_any_name(spark):
    rows = vectors(160, 4, 3, 5)
    df = spark.createDataFrame(rows, "`my id` long, `a.label` int, `group` array<double>").withColumns({"id": F.lit(1), "v": F.lit(2), "part": F.lit(3), "x": F.lit(4)})
    got = negatives.mine(df, "`my id` % 40 = 0", 2, 4, (20, 99), 64.0, "my id", "a.label", "group").collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == brute(rows, 40, 2, 4, 20, 99, 64.0)


@pytest.mark.parametrize("rows", [[], [(1, 1, [1.0])], [(50, None, None)], [(50, 1, [1.0, 2.0])]])
def test_nothing_to_mine(spark, rows):
    assert mined(spark, rows) == []


def test_intervals_hold_the_exact_scores_and_leave_most_pairs_out():
    x = (256 * np.array([v for _, _, v in vectors(3000, 64, 10, 2)]) / 12).astype(np.int64)
    anchors = x[::50]
    centroids = negatives.fit(x[:1000])
    codes, residuals = negatives.encode(x, centroids)
    low, high = negatives.intervals(anchors, centroids, codes, residuals)
    scores = x @ anchors.T
    assert ((low <= scores) & (scores <= high)).all()
    assert (high >= negatives._kth(low, 6)).mean() < 0.1  # of the pairs, what the first six of each anchor need


def test_recall_of_the_query_on_real_vectors(spark, data):
    """Every anchor's whole result is found: recall 1 against brute force."""
    df = spark.read.parquet(f"{data}/embeddings.parquet")
    rows = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], [float(c) for c in r["embedding"]]) for r in df.collect()]
    got = negatives.op12_negatives(spark, data).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == brute(rows)
