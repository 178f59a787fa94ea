"""The stages of the pipeline, each on its own input."""

import corpus_pipeline as P
from quarry.llm import minhash


def test_stages_and_run(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = docs
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, kept, data)
        assert out.columns == docs.columns, name
        rows = {r["doc_id"]: r["text"] for r in out.collect()}
        before = {r["doc_id"]: r["text"] for r in kept.collect()}
        assert set(rows) <= set(before) and len(rows) >= 0.7 * len(before), name
        if name == "near_duplicates":
            assert set(rows) == {r["doc_id"] for r in minhash.near_duplicates(kept).where("kept").collect()}
            assert all(rows[i] == before[i] for i in rows)
        if name == "decontamination":
            items = [r["text"] for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
            assert not any(t in rows[i] for i in rows for t in items)
        kept = spark.createDataFrame(out.collect(), docs.schema)
    packed = P.STAGES[-1][1](spark, kept, data)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in kept.collect()}
    assert sorted(map(tuple, P.run(spark, data).collect())) == sorted(map(tuple, packed.collect()))


def test_pipeline_of_nothing(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, data).count() == 0


def test_copies_are_rows_not_ids(spark, data):
    text = lambda i: " ".join(f"{w}{i}" for w in ("alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta"))
    near = " ".join(f"word{k}" for k in range(60))
    rows = [(None, text(1)), (None, text(2)), (None, text(2)), (None, text(3)), (3, text(3))]  # without ids
    rows += [(5, text(4)), (5, text(5)), (5, text(5)), (6, text(5))]  # one id, different texts
    rows += [(8, near), (8, near + " more"), (7, "less " + near), (None, near)]  # near copies
    rows += [(9, ""), (9, ""), (10, ""), (11, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], spark.read.parquet(f"{data}/documents.parquet").schema)
    got = [(r["doc_id"], r["text"]) for r in P.drop_copies(spark, docs, data).collect()]
    want = [(None, text(1)), (None, text(2)), (3, text(3)), (5, text(4)), (5, text(5)), (7, "less " + near), (9, ""), (10, ""), (11, None)]
    assert sorted(got, key=str) == sorted(want, key=str)
