"""What a Python worker holds at once: rows of a batch, scores of a search."""

import numpy as np
import pytest

from quarry.functions import providers
from quarry.operators import answers, retrieval, sections
from quarry.operators import batch_evaluation as BE
from quarry.sources import html

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXTS, PAGES = "doc_id long, text string", "page_id long, html string"
ANSWERS = "question_id long, baseline string, question string, answer string, truth string, sources string"


@pytest.mark.parametrize(
    "made",
    [
        lambda s: sections.split_parts(s.createDataFrame([], TEXTS), "act"),
        lambda s: sections.chunks(s.createDataFrame([], TEXTS)),
        lambda s: html.extract(s.createDataFrame([], PAGES)),
        lambda s: html.listing(s.createDataFrame([], PAGES)),
        lambda s: providers.embed(s.createDataFrame([], TEXTS), "text"),
        lambda s: answers.judged(s.createDataFrame([], ANSWERS), providers.Silent()),
        lambda s: BE.baseline_answers(s.createDataFrame([], "question_id long, question string"), {}),
    ],
)
def test_texts_go_to_python_in_small_batches(spark, made):
    before = spark.conf.get(ROWS)
    try:
        spark.conf.set(ROWS, "10000")
        made(spark)
        assert int(spark.conf.get(ROWS)) <= 1000
        spark.conf.set(ROWS, "77")
        made(spark)
        assert spark.conf.get(ROWS) == "77"  # a session's own choice stays
    finally:
        spark.conf.set(ROWS, before)


@pytest.mark.parametrize("cells, parts", [(1, 1), (64, 3), (1 << 20, 2)])
def test_a_search_for_many_questions_equals_brute_force(spark, monkeypatch, cells, parts):
    monkeypatch.setattr(retrieval, "CELLS", cells)
    rng = np.random.default_rng(5)
    x = rng.integers(-2, 3, (400, 4)).astype(float)  # many ties, some vectors of zeros
    chunks = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(rng.permutation(400), x, strict=True)], "id long, embedding array<double>").repartition(parts)
    asked = {i: rng.integers(-2, 3, 4).astype(float) + 0.5 for i in range(9)}
    questions = spark.createDataFrame([(i, v.tolist()) for i, v in asked.items()], "question long, embedding array<double>")
    own = {r["id"]: np.array(r["embedding"]) for r in chunks.collect()}
    want = []
    for i, q in asked.items():
        s = {k: round(float(v @ q / np.linalg.norm(q) / np.linalg.norm(v)), 6) + 0.0 if v.any() else 0.0 for k, v in own.items()}
        want += [(i, k, s[k]) for k in sorted(s, key=lambda k: (-s[k], k))[:7]]
    found = retrieval.search_many(chunks, questions, 7, 4)
    assert sorted((r["question"], r["id"], r["score"] + 0.0) for r in found.collect()) == sorted(want)
