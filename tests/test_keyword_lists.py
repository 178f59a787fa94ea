"""Postings in lists: what the two steps of an update return, and that no posting has a row of its own."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.operators import keywords
from quarry.sources.buckets import BUCKET

TEXTS = {1: "b a a", 2: None, 3: "", 4: "a c", 5: "c b a d", 6: "a", 7: "é1 a", None: "a e"}


@pytest.mark.parametrize("block, most, batch", [(1, 1, 1), (3, 2, 1), (4, 3, 2), (100, 2, 4), (100, 100, 100)])
def test_lists_equal_a_plain_loop(block, most, batch):
    rows = [(i, f"l{i}", (i or 0) % 2, None if t is None else list(dict.fromkeys(t.split()))) for i, t in reversed(TEXTS.items())]
    own = lambda w: sum(w.encode()) % 3
    columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.list_(pa.string()))]
    columns.append(pa.array([r[3] and [own(w) for w in r[3]] for r in rows], pa.list_(pa.int32())))
    given = pa.RecordBatch.from_arrays(columns, ["id", "link", "part", "words", "own"]).to_pylist()
    batches = [pa.RecordBatch.from_pylist(given[i : i + 3], pa.schema([(n, c.type) for n, c in zip(["id", "link", "part", "words", "own"], columns)])) for i in range(0, len(given), 3)]
    dealt = list(keywords.by_bucket(iter(batches)))
    for r in (r for b in dealt for r in b.to_pylist()):
        assert {own(w) for w in r["words"]} == {r[BUCKET]} and r["part"] == (r["id"] or 0) % 2
    lists = [r for b in keywords.inverted(iter(dealt), block, most, batch) for r in b.to_pylist()]
    assert all(r[BUCKET] == own(r["term"]) and 1 <= len(r["postings"]) <= most and r["first"] == r["postings"][0]["id"] for r in lists)
    found = [(r["term"], p["id"], p["link"]) for r in lists for p in r["postings"]]
    assert sorted(found, key=str) == sorted(((w, r[0], r[1]) for r in rows for w in r[3] or []), key=str)


def test_a_row_holds_many_postings(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("source").alias("link"), "text")
    copies = docs.crossJoin(spark.range(8).withColumnRenamed("id", "k")).withColumn("id", F.col("id") * 8 + F.col("k")).drop("k")
    index = keywords.KeywordIndex(spark, str(tmp_path / "k"), 4)
    index.update(copies, 1)
    words = copies.select("id", F.explode(keywords.tokens(F.col("text"))).alias("term"))
    held = index.postings.read()
    assert held.count() * 4 < words.count()
    assert held.select("term", F.inline("postings")).select("id", "term").exceptAll(words).isEmpty()
    assert words.exceptAll(held.select("term", F.inline("postings")).select("id", "term")).isEmpty()


def test_an_index_of_single_postings_is_refused(spark, tmp_path):
    spark.range(1).write.parquet(str(tmp_path / "k/postings"))
    with pytest.raises(ValueError, match="anew"):
        keywords.KeywordIndex(spark, str(tmp_path / "k"))
