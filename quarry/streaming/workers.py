"""Workers as streams: a breaker with state by key, a polling worker with dead letters, their replay, and
running totals while a stream runs.

What a micro-batch writes goes to a folder of its number, which a repetition overwrites, so each row is
written once however often a run is broken off and started again from its checkpoint.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from quarry.operators import records as R

#: Folder of a micro-batch's rows.
EPOCH = "epoch"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# ---- breaker ------------------------------------------------------------------------------------


class _Breaker(StatefulProcessor):
    """Counts a key's failures in a row; after ``limit`` of them none of its rows pass any more."""

    def __init__(self, limit: int, order: str):
        self.limit, self.order = limit, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "streak int, stopped boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        streak, stopped = self.run.get() if self.run.exists() else (0, False)
        if not stopped:
            batch = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")  # a key's rows of one micro-batch
            streaks = []
            for failed in batch["failed"]:
                streak = streak + 1 if failed else 0
                streaks.append(streak)
                if stopped := streak >= self.limit:
                    break
            self.run.update((streak, stopped))
            yield batch.iloc[: len(streaks)].drop(columns="failed").assign(streak=pd.array(streaks, dtype="int32"))

    def close(self) -> None:
        pass


def breaker_stream(events: DataFrame, key: str, order: str, failed: Column, limit: int) -> DataFrame:
    """Rows of a stream up to the one at which a key's ``limit`` failures in a row are reached, with the
    streak at each.

    The state is a number and a flag for each key, kept between micro-batches, so where these are cut makes
    no difference; rows must arrive in order, or within one micro-batch.  A success resets the streak.
    """
    events.sparkSession.conf.set(_STORE, _ROCKS)
    named = {f"c{i}": F.col(f"`{c}`") for i, c in enumerate(events.columns)}  # names as Python's tuples can have
    own = {c: f"c{i}" for i, c in enumerate(events.columns)}
    rows = events.select(*(c.alias(n) for n, c in named.items()), F.coalesce(failed, F.lit(False)).alias("failed"))
    fields = ", ".join(f"{own[f.name]} {f.dataType.simpleString()}" for f in events.schema)
    out = rows.groupBy(own[key]).transformWithStateInPandas(_Breaker(limit, own[order]), f"{fields}, streak int", "Append", "None")
    return out.select(*(F.col(n).alias(c) for c, n in own.items()), "streak")


# ---- polling ------------------------------------------------------------------------------------


def written_epochs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows that micro-batches have written, with their number."""
    return spark.read.schema(f"{schema}, {EPOCH} long").parquet(path)


def _put(rows: DataFrame, path: str, epoch: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/{EPOCH}={epoch}")


def poll(source: DataFrame, work: Callable[[DataFrame], DataFrame], target: str, dead: str, key: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Start a worker over a stream of records: ``work`` makes results of each micro-batch.

    How much a round takes is the source's admission control (``maxFilesPerTrigger`` and the like); rounds
    follow each other ``every`` so long, or at once until nothing is left.  A record that a batch repeats
    counts once.  Records of which ``work`` makes no result, and all of a batch at which it raises, are
    dead letters: (key, error) with the record as JSON, to be replayed.  A round that is broken off is
    repeated as it was and overwrites what it wrote.
    """

    def one(batch: DataFrame, epoch: int) -> None:
        batch = batch.dropDuplicates([key]).persist()
        letter = lambda rows, error: rows.select(F.col(key), error.alias("error"), F.to_json(F.struct(*batch.columns)).alias("record"))
        try:
            _put(work(batch), target, epoch)
            done = batch.sparkSession.read.parquet(f"{target}/{EPOCH}={epoch}")
            _put(letter(batch.join(done.select(key).distinct(), key, "left_anti"), F.lit("no result")), dead, epoch)
        except Exception as e:  # noqa: BLE001  whatever a worker's library raises: the records are kept with it
            _put(work_nothing(batch, work), target, epoch)
            _put(letter(batch, F.lit(f"{type(e).__name__}: {e}"[:500])), dead, epoch)
        finally:
            batch.unpersist()

    query = source.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (query.trigger(processingTime=every) if every else query.trigger(availableNow=True)).start()


def work_nothing(batch: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """No results, with the columns that results have where ``work`` can tell them."""
    try:
        return batch.sparkSession.createDataFrame([], work(batch.limit(0)).schema)
    except Exception:  # noqa: BLE001
        return batch.limit(0)


def replay(spark: SparkSession, dead: str, letter: str, cache: DataFrame, key: str, url: str, target: str, checkpoint: str) -> StreamingQuery:
    """Start a stream over dead letters that finds each a cached copy to retry from (records.retry_sources).

    letter: the letters' fields as DDL.  The cache is read anew for each micro-batch, and letters are
    joined to it once: later runs take only later letters.
    """
    letters = spark.readStream.schema(letter).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(dead)

    def one(batch: DataFrame, epoch: int) -> None:
        _put(R.retry_sources(batch, cache, key, url), target, epoch)

    return letters.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# ---- progress -----------------------------------------------------------------------------------


class RunningTotals(StreamingQueryListener):
    """Totals of each kind while a stream runs, from what its micro-batches observe.

    Rows are counted where they pass, in the tasks; the driver gets a row of counts for each micro-batch.
    """

    def __init__(self, name: str = "totals"):
        self.name, self.totals, self.said, self._held = name, {}, [], threading.Condition()

    def observed(self, stream: DataFrame, by: str, kinds: list[str]) -> DataFrame:
        """The stream, observed: one count for each of a bounded list of kinds."""
        self.kinds = list(kinds)
        return stream.observe(self.name, *(F.count_if(F.col(by) == k).alias(f"n{i}") for i, k in enumerate(kinds)))

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        row = event.progress.observedMetrics.get(self.name)
        if row is None:
            return
        with self._held:
            for i, kind in enumerate(self.kinds):
                if n := row[f"n{i}"]:
                    self.totals[kind] = self.totals.get(kind, 0) + n
                    self.said.append({"type": "progress", "data": {"source": kind, "record_count": self.totals[kind], "total_records": sum(self.totals.values())}})
            self._held.notify_all()

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        with self._held:
            self.said.append({"type": "complete", "data": {"record_count": sum(self.totals.values())}})
            self._held.notify_all()

    def events(self, timeout: float = 60.0) -> Iterator[str]:
        """Server-sent events as they come; the last when the stream has ended."""
        at = 0
        while True:
            with self._held:
                if not self._held.wait_for(lambda at=at: len(self.said) > at, timeout):
                    return
                new = self.said[at:]
            at += len(new)
            for e in new:
                yield f"data: {json.dumps(e)}\n\n"
                if e["type"] == "complete":
                    return
