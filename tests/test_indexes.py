"""Indexes and tables in buckets against plain loops, and what their reads and writes leave out."""

import os
import random
import re
import time
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import dictionary
from quarry.operators import keywords, records, retrieval, vectors
from quarry.sources import buckets
from quarry.sources.buckets import BUCKET


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def files(path) -> dict:
    """Parquet files of a table's buckets and when they were written."""
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet") and "/_" not in d}


# ---- tables in buckets --------------------------------------------------------------------------

POLICY = {"title": records.OVERWRITE, "content": records.KEEP_IF_EMPTY}


def table_of(spark, path):
    return buckets.Table(spark, str(path), "link string, title string, content string", ["link"])


def batch_of(spark, rows, n=8):
    return spark.createDataFrame(rows, "id long, link string, title string, content string").withColumn(BUCKET, buckets.bucket_of(F.col("link"), n))


def change(old, batch):
    return records.upsert(old.drop(BUCKET), batch, "link", POLICY, "id").withColumn(BUCKET, buckets.bucket_of(F.col("link"), 8))


def rows_of(table):
    return sorted((r["link"], r["title"], r["content"]) for r in table.read().collect())


def test_a_merge_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    t = table_of(spark, tmp_path / "t")
    t.merge("first", batch_of(spark, [(i, f"l{i}", "old", f"c{i}") for i in range(100)]), change)
    before = files(tmp_path / "t")
    assert len({os.path.dirname(f) for f in before}) == 8
    touched = t.merge("second", batch_of(spark, [(1, "l5", "new", ""), (2, "l5", "newer", None), (3, "extra", "x", "y")]), change)
    after = files(tmp_path / "t")
    assert 1 <= len(touched) <= 2
    for f, at in before.items():
        if int(re.search(r"bucket=(\d+)", f)[1]) not in touched:
            assert after[f] == at
    want = sorted([(f"l{i}", "old", f"c{i}") for i in range(100) if i != 5] + [("l5", "newer", "c5"), ("extra", "x", "y")])
    assert rows_of(t) == want
    assert t.merge("second", batch_of(spark, [(1, "l5", "again", "z")]), change) == [] and rows_of(t) == want and files(tmp_path / "t") == after


@pytest.mark.parametrize("broken", ["before the old rows are replaced", "after", "while new rows are written"])
def test_a_broken_merge_is_finished_or_undone(spark, tmp_path, monkeypatch, broken):
    t = table_of(spark, tmp_path / "t")
    t.merge("a", batch_of(spark, [(i, f"l{i}", "old", f"c{i}") for i in range(40)]), change)
    before, later = rows_of(t), batch_of(spark, [(i, f"l{i}", "new", "n") for i in range(10)])
    real = buckets.Table._written

    def dies(self, rows, path, mode):
        staging = "_staged" in path
        if broken.startswith("while") and staging:
            rows.limit(1).write.mode("append").parquet(f"{path}/{BUCKET}=0")
            os.remove(f"{path}/{BUCKET}=0/_SUCCESS")
            raise RuntimeError
        if broken.startswith("before") and not staging:
            raise RuntimeError
        real(self, rows, path, mode)
        if broken == "after" and not staging:
            raise RuntimeError

    monkeypatch.setattr(buckets.Table, "_written", dies)
    with pytest.raises(RuntimeError):
        t.merge("b", later, change)
    monkeypatch.setattr(buckets.Table, "_written", real)
    t.recover()
    new = [(f"l{i}", "new", "n") for i in range(10)] + [(f"l{i}", "old", f"c{i}") for i in range(10, 40)]
    assert rows_of(t) == (before if broken.startswith("while") else sorted(new))
    t.merge("b", later, change)  # the caller tries again
    assert rows_of(t) == sorted(new) and os.listdir(tmp_path / "t" / "_staged") == []


def test_buckets_that_lose_all_rows_and_empty_batches(spark, tmp_path):
    t = table_of(spark, tmp_path / "t")
    assert rows_of(t) == [] and t.merge("none", batch_of(spark, []), change) == []
    t.merge("a", batch_of(spark, [(1, "l1", "t", "c"), (2, None, "no link", "c")]), change)
    assert t.read().count() == 2
    gone = batch_of(spark, [(1, "l1", "t", "c")])
    t.merge("b", gone, lambda old, new: old.join(new.select("link"), "link", "left_anti"))
    assert [r["title"] for r in t.read().collect()] == ["no link"]


def test_saved_links_are_not_shuffled(spark, tmp_path):
    name = f"links_{uuid.uuid4().hex}"
    link = lambda ids: spark.createDataFrame([(i, f"l{i}" if i % 7 else None) for i in ids], "id long, link string")
    buckets.save_links(link(range(0, 300)), name, f"file://{tmp_path}/links", buckets=5)
    buckets.save_links(link(range(300, 400)), name, f"file://{tmp_path}/links", buckets=5)
    new = buckets.not_saved(link(range(350, 450)), name, buckets=5)
    tree = plan_of(new)
    assert sorted(r["id"] for r in new.collect()) == sorted(i for i in range(350, 450) if i >= 400 or i % 7 == 0)
    stored = tree[tree.rindex("LeftAnti") :]
    assert "Bucketed: true" in stored and tree.count("Exchange") == 1  # the batch's


# ---- keywords ---------------------------------------------------------------------------------

TEXTS = [
    (1, "a", "All rights reserved, a license of x"), (2, "a", "rights of all"), (3, "b", None), (4, "b", ""), (5, "c", "License license LICENSE"), (6, None, "no link but rights"),
    (7, "d", "abcdefghijklmnopqrst abcdefghijklmnopqrstu"), (8, "d", "éa über-word 42"),
]


def found(index, *words):
    return sorted(r["id"] for r in index.matching(list(words)).collect())


def test_keyword_index_and_its_updates(spark, tmp_path):
    chunks = lambda rows: spark.createDataFrame(rows, "id long, link string, text string")
    index = keywords.KeywordIndex(spark, str(tmp_path / "k"), 8)
    index.update(chunks(TEXTS), 1)
    assert found(index, "license") == [1, 5] and found(index, "ALL rights") == [1, 2] and found(index, "license", "no rights") == [1, 5, 6]
    assert found(index, "abcdefghijklmnopqrst") == [7] and found(index, "abcdefghijklmnopqrstu") == [] and found(index, "x") == [] and found(index, "x license") == [1, 5]
    assert found(index) == [] and found(index, "nothing") == [] and found(index, "42") == [8]
    again = chunks([(1, "a", "other words"), (9, "a", "a license"), (10, "e", "rights")])
    index.update(again, 2)
    index.update(again, 2)
    assert found(index, "license") == [5, 9] and found(index, "rights") == [6, 10] and found(index, "other") == [1]
    assert {r["term"]: r["documents"] for r in index.frequencies(["License", "rights", "nothing"]).collect()} == {"license": 2, "rights": 2}


def test_an_update_broken_off_counts_once_when_it_is_repeated(spark, tmp_path, monkeypatch):
    index = keywords.KeywordIndex(spark, str(tmp_path / "k"), 4)
    rows = spark.createDataFrame(TEXTS, "id long, link string, text string")
    index.update(rows, 1)
    with monkeypatch.context() as m:
        m.setattr(buckets.Table, "merge", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            index.update(rows.where("id = 2").withColumn("text", F.lit("license")), 2)
    assert found(index, "license") == [1, 5]  # nothing of it counts yet
    index.update(rows.where("id = 2").withColumn("text", F.lit("license")), 2)
    assert found(index, "license") == [2, 5]
    assert index.frequencies(["license"]).first()["documents"] == 2


def test_a_search_reads_the_buckets_of_its_terms(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("source").alias("link"), "text")
    index = keywords.KeywordIndex(spark, str(tmp_path / "k"), 32)
    index.update(docs, 1)
    plan = plan_of(index.found(["license", "rights"]))
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "term" in line)
    wanted = {spark.range(1).select(buckets.bucket_of(F.lit(w), 32)).first()[0] for w in ("license", "rights")}
    filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", scan)[1]
    assert {int(x) for x in re.findall(r"= (\d+)\)", filters)} == wanted and "In(term" in scan
    texts = {r["id"]: set(re.split("[^a-z0-9]+", (r["text"] or "").lower())) for r in docs.collect()}
    assert found(index, "license", "all rights") == sorted(i for i, t in texts.items() if "license" in t or {"all", "rights"} <= t)


# ---- vectors ----------------------------------------------------------------------------------


def brute(points, q, k, threshold):
    n = sum(x * x for x in q) ** 0.5
    out = []
    for i, v in points.items():
        if v is not None:
            m = sum(x * x for x in v) ** 0.5
            s = round(sum(a * b for a, b in zip(v, q)) / (m * n), 6) if m and n else 0.0
            if s >= threshold:
                out.append((-s, i))
    return [(i, -s + 0.0) for s, i in sorted(out)[:k]]


def test_vector_index_equals_brute_force_and_leaves_clusters_out(spark, tmp_path):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16)) * 4
    vector = lambda c: [float(np.float32(x)) for x in centres[c] + rng.normal(size=16)]
    points = {i: vector(i % 12) for i in range(600)}
    points |= {600: [0.0] * 16, 601: None, 602: points[3], 603: [-x for x in points[5]]}
    frame = lambda p: spark.createDataFrame([(i, v, i % 3) for i, v in p.items()], "id long, embedding array<float>, kind int")
    index = vectors.VectorIndex(spark, str(tmp_path / "v"), "kind int", 12)
    index.build(frame(points))

    def check(q, k, threshold, where=None, own=None):
        hits = index.search(q, k, threshold, where)
        got = [(r["id"], r["score"]) for r in hits.orderBy(F.desc("score"), "id").collect()]
        want = brute(own or points, q, k, threshold)
        assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([s for _, s in got], [s for _, s in want], atol=1.1e-6)
        return hits.clusters_read

    read = [len(check(vector(c), 10, 0.3)) for c in range(4)]
    assert max(read) <= 6  # of 13
    check(points[3], 3, 0.999999)
    check([0.0] * 16, 5, -1.0)
    check(list(rng.normal(size=16)), 700, -1.0)
    check(list(rng.normal(size=16)), 8, 0.9)
    check(points[7], 5, 0.0, F.col("kind") == 1, {i: v for i, v in points.items() if i % 3 == 1})
    moved = {1: vector(9), 2: None, 600: vector(0), 700: vector(4)}
    touched = index.upsert(frame(moved), 1)
    assert touched and len(touched) < 12 and index.upsert(frame(moved), 1) == []
    points |= moved
    for c in (0, 1, 4, 9):
        check(vector(c), 10, 0.3)


def test_vector_index_equals_a_search_of_all(spark, data, tmp_path):
    chunks = spark.read.parquet(f"{data}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding", "label")
    index = vectors.VectorIndex(spark, str(tmp_path / "v"), "label int", 16)
    index.build(chunks)
    q = list(chunks.where("id = 3").first()["embedding"])
    want = [(r["id"], r["score"]) for r in retrieval.search(chunks, q, 12, 0.0).collect()]
    assert [(r["id"], r["score"]) for r in index.search(q, 12, 0.0).collect()] == want


# ---- dictionaries -------------------------------------------------------------------------------


def test_dictionary_equals_a_test_for_each_phrase(spark):
    rng = random.Random(5)
    phrases = tuple({"".join(rng.choice("abc ") for _ in range(rng.randint(1, 5))) for _ in range(150)} | {"", "ABC", "é", "ims"})
    texts = [None, "", "claims é", *("".join(rng.choice("abc ") for _ in range(rng.randint(0, 40))) for _ in range(60))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["p"] for r in df.select("i", dictionary.phrases_in(F.col("t"), phrases).alias("p")).collect()}
    assert got == {i: [p for p in phrases if t is not None and p in t] for i, t in enumerate(texts)}
    words = {f"n{i}": tuple(p.lower() for p in phrases[i::9] if p) for i in range(9)}
    counted = lambda t: [(n, sum(w in t.lower() for w in ws), i) for i, (n, ws) in enumerate(words.items()) if any(w in t.lower() for w in ws)]
    got = {r["i"]: [tuple(x) for x in r["m"]] for r in df.select("i", retrieval.matched_words(F.col("t"), words).alias("m")).collect()}
    assert sum(map(len, words.values())) > dictionary.MANY and got == {i: counted(t or "") for i, t in enumerate(texts)}


def test_time_of_a_dictionary_does_not_grow_with_its_phrases():
    text = " ".join(f"word{i}" for i in range(20_000))
    took = []
    for n in (10, 10_000):
        phrases = tuple(f"phrase{i}" for i in range(n))
        dictionary.automaton(phrases)
        began = time.perf_counter()
        for _ in range(5):
            dictionary.held(phrases, text)
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0]
