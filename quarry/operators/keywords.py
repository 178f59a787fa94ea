"""Keyword search by an inverted index in files: postings by term, and each link's current version.

A search reads the buckets of its terms only.  An update appends the postings of the new versions of its
links; older ones stay in their files, but count no more.  Chunks go to the buckets of their words as one row
for each, and are inverted there in blocks of bounded size; so what is shuffled, sorted and written are rows
of many postings, not single ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.batches import small_batches, small_partitions
from quarry.operators.retrieval import LONGEST, SHORTEST, has_keywords, searched_words
from quarry.sources.buckets import BUCKET, Table, bucket_of


def tokens(text: Column, between: str = "[^a-z0-9]+") -> Column:
    """Distinct lower-case words that the index holds."""
    return F.filter(F.array_distinct(F.split(F.lower(text), between)), lambda w: F.length(w).between(SHORTEST, LONGEST))


#: Postings that a task inverts at once, the most of one row, and about as many as an Arrow batch goes on with.
BLOCK, LIST, BATCH = 1 << 20, 1 << 13, 1 << 16
#: Bytes that a block holds at most, if links are long.
BYTES = 1 << 28
#: Tasks and files that the postings of a bucket are dealt to, by the chunk's id.
FILES = 8


def _runs(of: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers starts, and the end of the last."""
    return np.concatenate([np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])), [len(of)]])


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks (id, link, part, words, the words' buckets) as (id, link, part, bucket, its words)."""
    for rows in batches:
        words, bucket = rows.column(3), rows.column(4).flatten().to_numpy()
        if not len(bucket):
            continue
        chunk = pc.list_parent_indices(words).to_numpy()
        key = chunk * (int(bucket.max()) + 1) + bucket
        order = np.argsort(key.astype(np.min_scalar_type(int(key.max()))), kind="stable")
        start = _runs(key[order])
        first = order[start[:-1]]
        of = pa.array(chunk[first])
        lists = pa.ListArray.from_arrays(pa.array(start, pa.int32()), words.flatten().take(pa.array(order)))
        yield pa.RecordBatch.from_arrays([*(rows.column(c).take(of) for c in range(3)), pa.array(bucket[first], pa.int32()), lists], ["id", "link", "part", BUCKET, "words"])


def inverted(batches: Iterator[pa.RecordBatch], block: int = BLOCK, most: int = LIST, batch: int = BATCH) -> Iterator[pa.RecordBatch]:
    """What ``by_bucket`` makes as (term, bucket, first, postings): ids and links by id, ``first`` is the first id.

    A term has a row in each block, and another after every ``most`` postings.
    """
    held, n, size = [], 0, 0
    for rows in batches:
        held.append(rows)
        n, size = n + len(rows.column(4).flatten()), size + rows.nbytes
        if n >= block or size >= BYTES:
            yield from _postings(held, most, batch)
            held, n, size = [], 0, 0
    if n:
        yield from _postings(held, most, batch)


def _postings(held: list[pa.RecordBatch], most: int, batch: int) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(held)
    rows = rows.take(pc.sort_indices(rows, [("id", "ascending")])).combine_chunks()
    ids, links, bucket, words = (rows[c].chunk(0) for c in ("id", "link", BUCKET, "words"))
    chunk, coded = pc.list_parent_indices(words).to_numpy(), words.flatten().dictionary_encode()
    code, own = coded.indices.to_numpy(), np.zeros(len(coded.dictionary), np.int32)
    own[code] = bucket.to_numpy()[chunk]
    order = np.argsort(code, kind="stable")
    code, chunk = code[order], chunk[order]
    term = _runs(code)
    place = np.arange(len(code)) - np.repeat(term[:-1], np.diff(term))
    start = np.append(np.flatnonzero(place % most == 0), len(code))
    at = 0
    while at < len(start) - 1:
        to = max(at + 1, int(np.searchsorted(start, start[at] + batch, "right")) - 1)
        of, which = pa.array(chunk[start[at] : start[to]]), code[start[at:to]]
        postings = pa.ListArray.from_arrays(pa.array(start[at : to + 1] - start[at], pa.int32()), pa.StructArray.from_arrays([ids.take(of), links.take(of)], ["id", "link"]))
        yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(which)), pa.array(own[which]), ids.take(pa.array(chunk[start[at:to]])), postings], ["term", BUCKET, "first", "postings"])
        at = to


class KeywordIndex:
    """postings (term, version and a list of id and link) by term, versions (link, version) by link."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, between: str = "[^a-z0-9]+"):
        self.buckets, self.between = buckets, between
        self.postings = Table(spark, f"{path}/lists", "term string, first long, version long, postings array<struct<id:bigint,link:string>>", ["term", "first"], files=FILES)
        self.versions = Table(spark, f"{path}/versions", "link string, version long", ["link"])
        if Table(spark, f"{path}/postings", "term string", ["term"])._exists():
            raise ValueError(f"{path} holds single postings, as indexes once did; make it anew in another folder")

    def update(self, chunks: DataFrame, version: int) -> None:
        """Index all chunks (id, link, text) of some links, in place of what these links had before.

        version: greater than any before; an update that is repeated changes nothing.  Chunks without a
        link belong to the empty one, which is replaced as a whole.
        """
        rows = chunks.select(F.col("id").cast("long").alias("id"), F.coalesce("link", F.lit("")).alias("link"), "text")
        links = rows.select("link").distinct().select("link", F.lit(version).cast("long").alias("version"), bucket_of(F.col("link"), self.buckets).alias(BUCKET))
        if self.versions._exists(f"/_done/{version}"):
            return
        small_batches(self.postings.spark)
        small_partitions(self.postings.spark)
        words = rows.select("id", "link", bucket_of(F.col("id"), FILES).alias("part"), tokens(F.col("text"), self.between).alias("words"))
        words = words.withColumn("own", F.transform("words", lambda w: bucket_of(w, self.buckets)))
        dealt = words.mapInArrow(by_bucket, f"id long, link string, part int, {BUCKET} int, words array<string>").repartition(BUCKET, "part")
        postings = dealt.mapInArrow(inverted, f"term string, {BUCKET} int, first long, postings array<struct<id:bigint,link:string>>")
        self.postings.append(postings.withColumn("version", F.lit(version).cast("long")), dealt=True)
        self.versions.merge(str(version), links, lambda old, new: old.join(new.select("link"), "link", "left_anti").unionByName(new))  # from here on they count

    def found(self, words: list[str]) -> DataFrame:
        """(term, id, link) of the current postings of some words."""
        if not words:
            return self.postings.spark.createDataFrame([], "term string, id long, link string")
        own = reduce(lambda a, b: a | b, (F.col(BUCKET) == bucket_of(F.lit(w), self.buckets) for w in words))
        rows = self.postings.read().where(own).where(F.col("term").isin(words)).select("term", "version", F.inline("postings"))
        return rows.join(self.versions.read().select("link", "version"), ["link", "version"], "left_semi").select("term", "id", "link").distinct()

    def matching(self, keywords: list[str]) -> DataFrame:
        """Ids of chunks that hold all words of any keyword; words that are too short or long do not count,
        and a keyword of no others finds nothing."""
        held = [k for k in keywords if searched_words(k)]
        rows = self.found(sorted({w for k in held for w in searched_words(k)}))
        if not held:
            return rows.select("id")
        return rows.groupBy("id").agg(F.collect_set("term").alias("terms")).where(has_keywords(F.col("terms"), held)).select("id")

    def frequencies(self, words: list[str]) -> DataFrame:
        """(term, documents) of some words: how many chunks hold each."""
        return self.found([w.lower() for w in words]).groupBy("term").agg(F.count("*").alias("documents"))
