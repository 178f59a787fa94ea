"""Stream workers: cuts of micro-batches, restarts from a checkpoint, dead letters, totals while running."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import records
from quarry.streaming import workers

EVENTS = "`the key` string, id long, failed boolean, note string"


def put(spark, folder, parts, schema):
    """A file for each part, in order."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{i:03d}")


def stream(spark, folder, schema, files=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(str(folder))


def passed(events, limit):
    streak, out = {}, []
    for k, i, failed, _ in events:
        if streak.get(k, 0) < limit:
            streak[k] = streak.get(k, 0) + 1 if failed else 0
            out.append((k, i, streak[k]))
    return sorted(out, key=str)


def run(df, folder, check):
    query = df.writeStream.format("parquet").option("path", str(folder)).option("checkpointLocation", str(check)).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


@pytest.mark.parametrize("cuts, files", [((), 1), ((40,), 1), ((5, 6, 20, 90), 1), ((5, 6, 20, 90), 3)])
def test_breaker_is_the_same_however_batches_are_cut(spark, tmp_path, cuts, files):
    rng = random.Random(6)
    events = [(rng.choice(["a", "b", "c", None]), i, rng.random() < 0.55 if i % 9 else None, "n") for i in range(120)]
    parts = [events[a:b] for a, b in zip((0, *cuts), (*cuts, len(events)))]
    put(spark, tmp_path / "in", [p[::-1] for p in parts], EVENTS)  # unordered within a part
    df = workers.breaker_stream(stream(spark, tmp_path / "in", EVENTS, files), "the key", "id", F.col("failed"), 3)
    run(df, tmp_path / "out", tmp_path / "check")
    got = [(r["the key"], r["id"], r["streak"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got, key=str) == passed(events, 3)


def test_breaker_keeps_its_state_over_a_restart(spark, tmp_path):
    events = [("a", i, i != 3, "n") for i in range(12)]
    for part in (events[:2], events[2:5], events[5:7], events[7:]):  # the third failure in a row is in the third run
        put(spark, tmp_path / "in" / str(part[0][1]), [part], EVENTS)
        run(workers.breaker_stream(stream(spark, tmp_path / "in", EVENTS), "the key", "id", F.col("failed"), 3), tmp_path / "out", tmp_path / "check")
    got = [(r["the key"], r["id"], r["streak"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == passed(events, 3) and len(got) == 3


RECORD, RESULT = "k long, text string", "k long, n int"


def poll(spark, tmp_path, work, files=1):
    return workers.poll(stream(spark, tmp_path / "in", RECORD, files), work, str(tmp_path / "done"), str(tmp_path / "dead"), "k", str(tmp_path / "check"))


def results(spark, tmp_path):
    done = workers.written_epochs(spark, str(tmp_path / "done"), RESULT)
    dead = workers.written_epochs(spark, str(tmp_path / "dead"), "k long, error string, record string")
    return sorted((r["k"], r["n"]) for r in done.collect()), sorted((r["k"], r["error"][:11], json.loads(r["record"])) for r in dead.collect())


def length(batch):
    return batch.where("text is not null").select("k", F.length("text").cast("int").alias("n"))


def test_poll_with_dead_letters_and_later_records(spark, tmp_path):
    put(spark, tmp_path / "in", [[(1, "a"), (2, None), (1, "a")], [(3, "ccc")], []], RECORD)
    poll(spark, tmp_path, length).awaitTermination()
    assert results(spark, tmp_path) == ([(1, 1), (3, 3)], [(2, "no result", {"k": 2})])
    poll(spark, tmp_path, length).awaitTermination()  # nothing new
    put(spark, tmp_path / "in" / "later", [[(4, "dd")]], RECORD)
    poll(spark, tmp_path, length).awaitTermination()
    assert results(spark, tmp_path) == ([(1, 1), (3, 3), (4, 2)], [(2, "no result", {"k": 2})])


def test_poll_records_a_batch_that_fails_and_goes_on(spark, tmp_path):
    def breaks(batch):
        if batch.where("text = 'bad'").count():
            raise ValueError("no such model")
        return length(batch)

    put(spark, tmp_path / "in", [[(1, "a"), (2, "bad")], [(3, "ccc")]], RECORD)
    poll(spark, tmp_path, breaks).awaitTermination()
    done, dead = results(spark, tmp_path)
    assert done == [(3, 3)] and dead == [(1, "ValueError:", {"k": 1, "text": "a"}), (2, "ValueError:", {"k": 2, "text": "bad"})]


def test_poll_broken_off_in_a_round_loses_and_repeats_nothing(spark, tmp_path, monkeypatch):
    put(spark, tmp_path / "in", [[(i, "x" * i)] for i in range(1, 7)], RECORD)
    real, calls = workers._put, []

    def dies(rows, path, epoch):
        calls.append(epoch)
        if len(calls) > 3:  # the second round's results are written, its dead letters are not, nor can they be
            raise OSError("no disk")
        real(rows, path, epoch)

    monkeypatch.setattr(workers, "_put", dies)
    query = poll(spark, tmp_path, length, 2)
    with pytest.raises(Exception):  # noqa: B017
        query.awaitTermination()
    monkeypatch.setattr(workers, "_put", real)
    poll(spark, tmp_path, length, 2).awaitTermination()
    assert results(spark, tmp_path) == ([(i, i) for i in range(1, 7)], [])


def test_replay_takes_each_letter_once(spark, tmp_path):
    letter = "id int, k string, url string"
    cache = spark.createDataFrame([(i, "k", f"u/{i}?p") for i in range(20)] + [(99, "k", "u/3")], "copy int, k string, url string")
    rows = [[(1, "k", "u/3"), (2, "k", "u/1")], [(3, "k", "nothing"), (4, None, "u/1")], [(5, "k", "u/7?p")]]
    run_ = lambda: workers.replay(spark, str(tmp_path / "in"), letter, cache, "k", "url", str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    put(spark, tmp_path / "in" / "a", rows[:2], letter)
    run_()
    run_()
    put(spark, tmp_path / "in" / "b", rows[2:], letter)
    run_()
    got = workers.written_epochs(spark, str(tmp_path / "out"), f"{letter}, copy int").collect()
    want = records.retry_sources(spark.createDataFrame([r for p in rows for r in p], letter), cache, "k", "url").collect()
    assert sorted((r["id"], r["copy"]) for r in got) == sorted((r["id"], r["copy"]) for r in want) == [(1, 99), (2, 1), (3, None), (4, None), (5, 7)]


def test_totals_while_a_stream_runs(spark, tmp_path):
    parts = [[("rbi", 1), ("sebi", 2)], [("rbi", 3)], [("other", 4), ("sebi", 5), ("rbi", 6)]]
    put(spark, tmp_path / "in", parts, "source string, id long")
    totals = workers.RunningTotals()
    observed = totals.observed(stream(spark, tmp_path / "in", "source string, id long"), "source", ["rbi", "sebi", "mca"])
    spark.streams.addListener(totals)
    try:
        query = run(observed, tmp_path / "out", tmp_path / "check")
        said = [json.loads(e[6:]) for e in totals.events()]
    finally:
        spark.streams.removeListener(totals)
    assert totals.totals == {"rbi": 3, "sebi": 2} and query.exception() is None
    of = lambda kind: [e["data"]["record_count"] for e in said if e["data"].get("source") == kind]
    assert of("rbi") == [1, 2, 3] and of("sebi") == [1, 2] and [e["data"]["total_records"] for e in said[:-1]] == sorted(e["data"]["total_records"] for e in said[:-1])
    assert said[-1] == {"type": "complete", "data": {"record_count": 5}}
