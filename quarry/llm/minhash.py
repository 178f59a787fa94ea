"""MinHash near-duplicates (operator 1): fast similarity sketching, banding, exact verification.

Sketching: in round i every shingle is hashed to a bin and a value; a bin keeps the least (round,
value).  After as many rounds as there are bins, round t + j puts every shingle into bin j, so that
every coordinate fills; a set stops as soon as all its bins are full, mostly after a few rounds.  Two
sets agree in a coordinate with a probability of their Jaccard similarity, with concentration bounds.

Coordinates are banded.  Equal shingle sets are represented by their least document.  In each bucket
of a band every set is compared with the bucket's least document; what that leaves in different
components is compared within the bucket, across components only.  So a group of thousands of near
copies costs a few comparisons for each member.  Each comparison is made on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import wordhash as H
from quarry.llm.common import by_column, components, discard, materialize, texts_of

#: 32 bands of 5: a pair at a similarity of 0.8 shares no band with a probability of 3e-6, at 0.82 of 3e-7.
BANDS, ROWS = 32, 5
_LOW = np.uint64((1 << 48) - 1)


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and offsets (len(texts) + 1).

    A text of fewer words has its whole sequence as one shingle, one without words none.  The number
    of words in a shingle is part of its hash.
    """
    sets: list[np.ndarray] = []
    counts = np.zeros(len(texts) + 1, dtype=np.int64)
    for a, b in H.blocks(texts):
        _, _, _, h, first = H.words(texts[a:b], lower=True)
        full = H.shingles(h, words)
        sizes = np.diff(first)
        count = np.where(sizes >= words, sizes - words + 1, np.minimum(sizes, 1))
        begin = np.cumsum(count) - count
        where = np.repeat(np.arange(b - a), count)
        values = np.empty(len(where), dtype=H.U64)
        long_ = np.flatnonzero(sizes[where] >= words)
        values[long_] = full[(first[where] - begin[where])[long_] + long_]
        for i in np.flatnonzero((sizes > 0) & (sizes < words)).tolist():
            values[begin[i]] = H.shingles(h[first[i] : first[i + 1]], sizes[i])[0] ^ H.constant(f"size {sizes[i]}")
        for lo, hi in zip(begin.tolist(), (begin + count).tolist(), strict=True):  # short sorts are much faster than one of pairs
            values[lo:hi].sort()
        keep = np.ones(len(values), dtype=bool)
        keep[1:] = (values[1:] != values[:-1]) | (where[1:] != where[:-1])
        sets.append(values[keep])
        counts[a + 1 : b + 1] = np.bincount(where[keep], minlength=b - a)
    return (np.concatenate(sets) if sets else np.empty(0, dtype=H.U64)), np.cumsum(counts)


def sketches(values: np.ndarray, offsets: np.ndarray, bins: int) -> np.ndarray:
    """Sketch coordinates (sets x bins) of non-empty sets; an empty set's row holds the largest value."""
    n = len(offsets) - 1
    out = np.full(n * bins, np.iinfo(np.uint64).max, dtype=np.uint64)
    row = np.repeat(np.arange(n), np.diff(offsets))
    for r in range(2 * bins):
        if not len(values):
            break
        h = H.mix(values ^ H.constant(f"round {r}"))
        bin_ = ((h >> np.uint64(48)) * np.uint64(bins) >> np.uint64(16)).astype(np.int64) if r < bins else r - bins
        np.minimum.at(out, row * bins + bin_, np.uint64(r << 48) | (h & _LOW))
        full = (out.reshape(n, bins) != np.iinfo(np.uint64).max).all(axis=1)
        if full.any():
            go = ~full[row]
            values, row = values[go], row[go]
    return out.reshape(n, bins)


def sketch_table(docs: DataFrame, words: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, bands): size, 128-bit fingerprint and band hashes of each set."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                values, offsets = shingle_sets(texts_of(part.column(1)), words)
                n = np.diff(offsets)
                with np.errstate(over="ignore"):
                    sums = [np.concatenate([[np.uint64(0)], np.cumsum(H.mix(values ^ H.constant(f"set {k}")))]) for k in "ab"]
                    prints = [(s[offsets[1:]] - s[offsets[:-1]]).astype(np.int64) for s in sums]
                keys = np.empty((part.num_rows, bands), dtype=np.int64)
                for j in range(0, part.num_rows, 250):  # bounds the sketches' memory
                    k = min(j + 250, part.num_rows)
                    found = sketches(values[offsets[j] : offsets[k]], offsets[j : k + 1] - offsets[j], bands * rows)
                    for b in range(bands):
                        with np.errstate(over="ignore"):
                            total = np.zeros(k - j, dtype=np.uint64) + H.constant(f"band {b}")
                            for c in range(rows):
                                total = H.mix(total + found[:, b * rows + c] * H.constant(f"row {c}"))
                        keys[j:k, b] = total.astype(np.int64)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), *map(pa.array, prints), flat], names=["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    schema = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"
    return docs.mapInArrow(sketch, schema)


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union.

    Only the texts of documents in pairs are moved; they are turned to sets once, and travel as such.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                values, offsets = shingle_sets(texts_of(part.column(1)), words)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([values[a:b].tobytes() for a, b in zip(offsets, offsets[1:], strict=False)], pa.binary())], names=["doc_id", "s"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(z.as_buffer(), dtype=np.uint64) for z in (x, y))
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    wanted = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    own = materialize(docs.join(wanted.hint("merge"), "doc_id", "left_semi").mapInArrow(sets, "doc_id long, s binary"), "sets")
    side = lambda c: own.select(F.col("doc_id").alias(c), F.col("s").alias(f"s_{c}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "s_a", "s_b")
    out = materialize(joined.mapInArrow(compare, "a long, b long"), "confirmed")
    discard(own)
    return out


def across(sets: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) of sets in different components that can be similar, by an exact prefix filter.

    sets: (doc_id, n, c).  Of a set's n shingles, rarest first, two similar sets share one among the
    first n - ceil(n * percent / 100) + 1; where they share it bounds their intersection.  A passage
    that many documents hold is frequent and thus in no prefix but those of documents that consist of
    it, and these were joined by the smallest set of their bucket.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                values, offsets = shingle_sets(texts_of(part.column(1)), words)
                where = np.repeat(np.arange(part.num_rows), np.diff(offsets))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(where)), pa.array(values.astype(np.int64))], names=["doc_id", "s"])

    own = docs.join(sets.select("doc_id").hint("merge"), "doc_id", "left_semi").mapInArrow(explode, "doc_id long, s long")
    own = materialize(own, "shingles")
    shared = own.groupBy("s").agg(F.count("*").alias("f")).where("f > 1")
    held = own.join(shared, "s").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("f", "s"))).alias("held"))
    reach = f"n - ceil(n * {percent} / 100) + 1"
    prefix = sets.join(held, "doc_id").select("doc_id", "n", "c", F.expr("n - size(held)").alias("single"), "held")
    prefix = prefix.where(f"{reach} > single").select("doc_id", "n", "c", "single", F.posexplode(F.expr(f"slice(held, 1, cast({reach} - single as int))")).alias("i", "h"))
    prefix = materialize(prefix.select("doc_id", "n", "c", (F.col("i") + F.col("single")).alias("i"), F.col("h.s").alias("s")), "prefixes")
    x, y = (prefix.select("s", *(F.col(c).alias(f"{c}_{t}") for c in ("doc_id", "n", "c", "i"))) for t in "xy")
    bound = f"doc_id_x > doc_id_y and c_x <> c_y and least(n_x, n_y) * 100 >= {percent} * greatest(n_x, n_y) and least(n_x - i_x, n_y - i_y) * {100 + percent} >= {percent} * (n_x + n_y)"
    pairs = x.join(y, "s").where(bound).select(F.col("doc_id_x").alias("a"), F.col("doc_id_y").alias("b"))
    out = materialize(pairs.distinct(), "across")
    discard(own, prefix)
    return out


def _missed(members: DataFrame, label: DataFrame, docs: DataFrame, first: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between sets of one bucket that the hubs left in different components."""
    labelled = members.join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", "n", F.coalesce("component", "doc_id").alias("c"))
    labelled = materialize(labelled, "labelled")
    mixed = labelled.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
    left = materialize(labelled.join(mixed, "key", "left_semi").groupBy("doc_id").agg(F.first("n").alias("n"), F.first("c").alias("c")), "left")
    discard(labelled)
    near = across(left, docs, words, percent)
    rest = materialize(near.join(first, ["a", "b"], "left_anti"), "pairs")
    out = confirmed(rest, docs, words, percent)
    discard(left, near, rest)
    return out


def near_duplicates(documents: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", by_hubs: bool = False, bands: int = BANDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of documents.

    Components of links at percent of Jaccard similarity on shingles of ``words`` words, letters A-Z in
    lower case.  Null, empty and white-space texts have no shingles, link with nothing and are kept.
    An id names one document: rows that repeat it belong together, so what is like either of their texts
    is in one component; each row is returned.
    A row without an id belongs to the component of the equal texts with one; without such it has a null
    component and no say about keeping.  With ``by_hubs`` only links with the hubs of a set's buckets are
    followed, which is enough where classes serve for counting.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    table = materialize(sketch_table(docs, words, bands), "sketches")
    groups = materialize(table.where("n_shingles > 0").groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep")), "groups")
    reps = table.join(groups.select(F.col("rep").alias("doc_id"), "set_a", "set_b", "n_shingles"), ["doc_id", "set_a", "set_b", "n_shingles"], "left_semi").dropDuplicates(["doc_id", "set_a"])
    buckets = reps.select("doc_id", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    # a bucket's hubs: its least document (mostly what the others were copied from), its smallest set
    hubs = buckets.groupBy("key").agg(F.min(F.struct("doc_id", "n")).alias("least"), F.min("n").alias("fewest"), F.count("*").alias("size")).where("size > 1")
    members = materialize(buckets.join(hubs.select("key", "least", "fewest"), "key"), "members")
    fits = lambda hub, size: f"{hub} <> doc_id and least({size}, n) * 100 >= {percent} * greatest({size}, n)"
    small = members.where("n = fewest").groupBy("key").agg(F.min("doc_id").alias("small"))
    least = members.where(fits("least.doc_id", "least.n")).groupBy("doc_id").agg(F.min("least.doc_id").alias("hub"))
    small = members.where(f"fewest * 100 >= {percent} * n").join(small, "key").where("small <> doc_id").groupBy("doc_id").agg(F.min(F.struct("fewest", "small")).alias("h")).select("doc_id", F.col("h.small").alias("hub"))
    first = least.unionByName(small)
    first = materialize(first.select(F.greatest("doc_id", "hub").alias("a"), F.least("doc_id", "hub").alias("b")).distinct(), "pairs")
    links = confirmed(first, docs, words, percent)
    label = components(links)
    if not by_hubs:
        missed = _missed(members, label, docs, first, words, percent)
        label = components(links.unionByName(missed))
        discard(missed)
    discard(members, first, links)
    named = groups.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("set_a", "set_b", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    full = table.where("n_shingles > 0").join(named, ["set_a", "set_b", "n_shingles"])
    out = full.select("doc_id", "n_shingles", "component_id").unionByName(table.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op1_minhash(spark, sf_dir) -> DataFrame:
    """All documents on shingles of four words at 80 percent."""
    return near_duplicates(by_column(spark, sf_dir, "documents"), words=4)


ORACLE_SQL = r"""
with recursive words as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
sets as (select distinct doc_id, unnest(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from words),
sizes as (select doc_id, count(*) as n from sets group by 1),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from sets a join sets b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
edges as (select a, b from links union select b, a from links),
reach(doc_id, other) as (select doc_id, doc_id from documents union select r.doc_id, e.b from reach r join edges e on e.a = r.other)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept
from (select doc_id, min(other) as component_id from reach group by 1) left join sizes using (doc_id)
"""
