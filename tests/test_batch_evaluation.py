"""Evaluation of a batch, end to end, against a plain loop."""

import json

import pytest

from quarry.operators import batch_evaluation as B
from quarry.operators.answers import SOURCED, UNSOURCED

HIT = "question_id long, rank int, id long, score double, source string, number string, title string, date string, link string, kind string, chunk_index int, total_chunks int, text string"
ASKED = "question_id long, question string, truth string, custom string"
QUESTIONS = [(1, "What must banks file?", "returns", "a brought one"), (2, "What must funds file?", None, None), (3, "What of nothing?", "nothing", ""), (4, "What breaks the own model?", "x", "brought")]
HITS = [(q, r, 10 * q + r, 0.9 - r / 10, "rbi", None if r == 2 else f"N{r}", f"T{q}", None, None, "general", 0, 1, f"text {q} {r}") for q in (1, 2, 4) for r in (1, 2)]


class Own:
    def generate(self, prompt, temperature=0.0):
        if "breaks" in prompt:
            raise RuntimeError("no answer")
        assert "[1] Source: rbi" in prompt and "[2] Source: rbi" in prompt
        return "own " + "x" * (len(prompt) % 7)


class Named:
    def __init__(self, name):
        self.name = name

    def generate(self, prompt, temperature=0.0):
        assert "Source:" not in prompt
        return f" {self.name} {prompt.rsplit(chr(10), 1)[-1]} "


class Judge:
    """Scores by the length of its prompt; no criterion for one answer, no JSON for another."""

    def generate(self, prompt, temperature=0.0):
        assert ("Sources:\n" in prompt) == (SOURCED in prompt) != (UNSOURCED in prompt)
        if "gpt What must funds" in prompt:
            return "no json"
        if "gpt What of nothing" in prompt:
            return '{"scores": []}'
        return json.dumps({"scores": [{"criterion": c, "score": (len(prompt) * k) % 8} for c, k in (("accuracy", 3), ("depth", 5), ("nuance", 1))]})


def test_a_batch_equals_a_loop(spark):
    questions, hits = spark.createDataFrame(QUESTIONS, ASKED), spark.createDataFrame(HITS, HIT)
    found, scores, report = B.evaluate(questions, hits, Own(), {"gpt": Named("gpt"), "gemini": Named("gemini")}, Judge())
    rows = {(r["question_id"], r["baseline"]): r for r in found.collect()}
    assert set(rows) == {(q[0], b) for q in QUESTIONS for b in ("rag", "gpt", "gemini")} | {(1, "custom"), (4, "custom")}
    said = {}
    for r in scores.where("error is null").collect():
        said.setdefault((r["question_id"], r["baseline"]), []).append(r["score"])
    for key, r in rows.items():
        if key in ((4, "rag"), (2, "gpt")):
            assert r["average"] is None and r["total"] is None and r["error"] and r["advantage"] is None
            continue
        own, mine = rows[key[0], "rag"]["average"], said.get(key, [])
        assert all(1 <= s <= 5 for s in mine) and r["total"] == sum(mine) and r["error"] is None
        assert r["average"] == pytest.approx(round(sum(mine) / len(mine), 2) if mine else 0.0)
        assert r["advantage"] is None if key[1] == "rag" or own is None else r["advantage"] == pytest.approx(own - r["average"])
    assert rows[3, "gpt"]["average"] == 0.0 and rows[3, "rag"]["answer"] == B.NOTHING and rows[1, "custom"]["answer"] == "a brought one"
    by = {r["baseline"]: r for r in report.collect()}
    own = round(sum(rows[q, "rag"]["average"] for q in (1, 2, 3)) / 3, 2)
    for name, r in by.items():
        mine = [x for (_, b), x in rows.items() if b == name and x["average"] is not None]
        mean = round(sum(x["average"] for x in mine) / len(mine), 2)
        assert (r["questions"], r["failed"]) == (len(mine), sum(b == name and x["error"] is not None for (_, b), x in rows.items())) and r["mean"] == pytest.approx(mean)
        ahead = [x["advantage"] for x in mine if x["advantage"] is not None]
        assert (r["advantage"], r["wins"]) == (None, None) if name == "rag" else r["advantage"] == pytest.approx(round(own - mean, 2)) and (r["wins"], r["losses"], r["ties"]) == (sum(a > 0 for a in ahead), sum(a < 0 for a in ahead), sum(a == 0 for a in ahead))
        assert set(r["criteria"]) == {"accuracy", "depth", "nuance"}


def test_hits_by_source_text_and_rank(spark):
    chunks = [(1, "rbi", "a", [1.0, 0.0]), (2, "sebi", "a", [1.0, 0.0]), (3, "rbi", "a", [1.0, 0.1]), (4, "rbi", "b", [1.0, 1.0]), (5, "rbi", "c", [0.0, 1.0]), (6, "rbi", "d", None)]
    chunks = spark.createDataFrame(chunks, "id long, source string, text string, embedding array<double>")
    asked = lambda rows: spark.createDataFrame(rows, "question_id long, source string, embedding array<double>")
    got = B.retrieved(asked([(1, None, [1.0, 0.0]), (2, "SEBI", [1.0, 0.0]), (3, "cbic", [1.0, 0.0])]), chunks).collect()
    assert sorted((r["question_id"], r["rank"], r["id"]) for r in got) == [(1, 1, 1), (1, 2, 4), (2, 1, 2)]
    assert B.retrieved(asked([]), chunks).collect() == []
    with pytest.raises(ValueError):
        B.retrieved(asked([(1, "nowhere", [1.0, 0.0])]), chunks)


def test_no_questions_and_reserved_names(spark):
    none = spark.createDataFrame([], ASKED)
    found, scores, report = B.evaluate(none, spark.createDataFrame([], HIT), Own(), {}, Judge())
    assert found.count() == scores.count() == report.count() == 0
    with pytest.raises(ValueError):
        B.all_answers(none, spark.createDataFrame([], HIT), Own(), {"custom": Own()})
