"""Cases that grow: branches of outcomes, chains, diamonds, retries of one key."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import graph, records
from quarry.streaming import progress


def test_outcomes(spark):
    rows = [("x" * 10, None), ("x" * 11, None), (" " * 300, None), ("x" * 199, None), ("x" * 200, None), ("x" * 300, "timeout"), (None, None)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, e string").select(records.outcome(F.col("t"), F.col("e"))).collect()]
    assert got == ["failed", "partial", "failed", "partial", "success", "failed", "failed"]


def test_long_chains_diamonds_and_cycles(spark):
    chain = [(i, i + 1) for i in range(500)]
    diamonds = [(1000 + 2 * i + a, 1000 + 2 * (i + 1) + b) for i in range(30) for a in (0, 1) for b in (0, 1)]
    cycle = [(2000 + i, 2000 + (i + 1) % 7) for i in range(7)]
    edges = spark.createDataFrame(chain + diamonds + cycle, "src long, dst long")
    starts = spark.createDataFrame([(0,), (1000,), (2003,), (None,)], "node long")
    got = {r["start"]: r["n"] for r in graph.reachable(edges, starts.where("node is not null")).groupBy("start").agg(F.count("*").alias("n")).collect()}
    assert got == {0: 501, 1000: 61, 2003: 7}


def test_retries_of_one_key_make_no_pairs(spark):
    failures = spark.createDataFrame([(i, "k", f"u/{i % 300}") for i in range(3000)] + [(9001, "k", None), (9002, None, "u/1")], "id int, k string, url string")
    cache = spark.createDataFrame([(i, "k", f"u/{i % 500}?p={i % 3}") for i in range(3000)] + [(7, "k", "u/5"), (6, "other", "u/5")], "copy int, k string, url string")
    got = {r["id"]: r["copy"] for r in records.retry_sources(failures, cache, "k", "url").collect()}
    want = {}
    for i in range(3000):
        url = f"u/{i % 300}"
        want[i] = 7 if url == "u/5" else min(c for c in range(3000) if f"u/{c % 500}?p={c % 3}".startswith(url))
    assert {i: got[i] for i in want} == want and got[9001] is None and got[9002] is None and len(got) == 3002


def test_ids_follow_the_order(spark):
    stored = spark.createDataFrame([(41,)], "n long")
    out = records.with_ids(stored, spark.range(1000).repartition(7), "n", "id").collect()
    assert sorted((r["id"], r["n"]) for r in out) == [(i, 42 + i) for i in range(1000)]


def _reachable(edges, starts):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    out = set()
    for s in starts:
        todo, seen = [s], {s}
        while todo:
            for b in after.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        out |= {(s, n) for n in seen}
    return out


@pytest.fixture
def counted(monkeypatch):
    """Rows of every table that a walk writes."""
    rows = []

    def count(df, **facts):
        out = progress.written_and_observed(df, **facts)
        rows.append(out[0].count())
        return out

    monkeypatch.setattr(graph, "written", count)
    return rows


def test_a_hub_is_not_squared(spark, counted):
    edges = [(i, 5000) for i in range(1500)] + [(5000, 6000 + i) for i in range(1500)]
    got = {tuple(r) for r in graph.reachable(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(7,)], "node long")).collect()}
    assert got == _reachable(edges, [7]) and len(got) == 1502
    assert sum(counted) <= 3 * len(edges) + 2 * len(got)  # ends, runs and edges once; 2,250,000 pairs otherwise


def test_a_chain_of_thousands(spark, counted):
    edges = [(i, i + 1) for i in range(5000)] + [(9000 + i, 9000 + (i + 1) % 50) for i in range(50)]
    got = {tuple(r) for r in graph.reachable(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(0,), (4990,), (9010,)], "node long")).collect()}
    assert got == _reachable(edges, [0, 4990, 9010]) and len(got) == 5001 + 11 + 50
    assert len(counted) < 25 and max(counted) <= max(len(edges), len(got))


@pytest.mark.parametrize("seed, n, degree", [(1, 60, 1.0), (2, 80, 1.6), (3, 200, 1.1), (4, 40, 4.0)])
def test_random_graphs(spark, seed, n, degree):
    rng = random.Random(seed)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(int(n * degree))]
    edges += edges[:5] + [(None, 1), (2, None)]
    starts = rng.sample(range(n), 6) + [10_000]
    got = sorted(tuple(r) for r in graph.reachable(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(s,) for s in starts], "node long")).collect())
    assert got == sorted(_reachable([e for e in edges if None not in e], starts))


@pytest.mark.parametrize("few, plain", [(0, 32), (1000, 2), (1000, 32), (3, 32)])
def test_a_walk_of_few_nodes_equals_that_of_many(spark, monkeypatch, few, plain):
    monkeypatch.setattr(graph, "FEW", few)
    monkeypatch.setattr(graph, "PLAIN", plain)
    pairs = [(i + 1, i) for i in range(40)] + [(100, 7), (101, 100), (7, 101), (200, 200), (3, 20), *((300 + i, 5) for i in range(9))]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    starts = spark.createDataFrame([(5,), (100,), (999,)], "node long")
    want = set()
    for s in (5, 100, 999):
        for both in (pairs, [(b, a) for a, b in pairs]):
            found, new = {s}, {s}
            while new := {b for a, b in both if a in new} - found:
                found |= new
            want |= {(s, x) for x in found}
    rows = [tuple(r) for r in graph.chain(edges, starts).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_a_walk_from_one_node_makes_no_tables_of_runs(spark, monkeypatch):
    def runs(single):
        raise AssertionError("a table of all nodes")

    monkeypatch.setattr(graph, "_runs", runs)
    edges = spark.range(1000).selectExpr("id as src", "id + 1 as dst").where("src % 10 <> 9")
    assert graph.chain(edges, spark.createDataFrame([(14,)], "node long")).count() == 10


def test_walks_have_small_partitions_unless_the_session_chose(spark):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    try:
        for value, want in (("64MB", str(16 << 20)), ("8m", "8m")):
            spark.conf.set(key, value)
            graph.latest(spark.createDataFrame([(2, 1)], "src long, dst long"), spark.createDataFrame([(1,)], "node long"), spark.createDataFrame([(1, "a"), (2, "b")], "node long, date string"))
            assert spark.conf.get(key) == want or int(spark.conf.get(key).rstrip("b")) == 8 << 20
    finally:
        spark.conf.set(key, before)
