"""Line dedup (operator 4): a log-template tree; templates that recur across documents are dropped.

A line goes down a tree of fixed depth: by its number of tokens, then by its leading tokens, where a
token with a digit counts as a variable field.  At the leaf it belongs to the template of all its tokens
with such fields masked.  Lines of one leaf are merged into a wider template where enough of their tokens
agree: the tokens after the leading ones lie in up to PARTS parts, and lines that agree in all but one
part share the template in which that part is a field.  So names and words may vary too, and a leaf of
any size is merged by grouping, without comparing its lines with each other.

A template recurs if texts of enough near-duplicate classes hold it.  Copies and near copies of a document
are one class, however many there are, and are left to document dedup; a line that a text repeats counts
once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import wordhash as H
from quarry.llm.common import by_column, discard, materialize, texts_of
from quarry.llm.minhash import near_duplicates

#: Leading tokens of the tree, least tokens of a template, parts of the other tokens, least tokens that a
#: merged template has outside its field, and the least number of near-duplicate classes.
DEPTH, SHORT, PARTS, AGREE, RECUR = 2, 3, 4, 4, 10
#: Bands of the classes' sketches: a pair at a similarity of 0.8 shares none with a probability of 0.002.
CLASS_BANDS = 16
#: Templates that are sent to every task (8 bytes each); beyond that they are joined.
MOST_KEYS = 1_000_000
_BLANK = b" \t\n\v\f\r"
_FIELD = H.constant("variable field")


def templates(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, line, key) of each template of each line that has any; a text's line numbers count
    newlines from 0."""
    parts = []
    for a, b in H.blocks(texts):
        buf, starts, ends, h, first = H.words(texts[a:b])
        if not len(h):
            continue
        h[np.searchsorted(starts, np.flatnonzero(buf - 48 < 10), side="right") - 1] = _FIELD  # words with a digit
        newlines = np.flatnonzero(buf == 10)
        doc = np.repeat(np.arange(b - a), np.diff(first))
        offset = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts[a:b]])])
        line = np.searchsorted(newlines, starts) + doc  # a text begins a line
        begin = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
        count = np.diff(np.append(begin, len(h)))
        place = np.arange(len(h)) - np.repeat(begin, count)
        power = np.full(int(count.max()), H.constant("place"), dtype=np.uint64)
        power[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(power, out=power)
            term = h * power[place]
            tail = np.maximum(0, count - DEPTH)
            some = np.repeat(np.minimum(PARTS, tail), count)
            part = np.where(place < DEPTH, -1, (place - DEPTH) * some // np.maximum(1, np.repeat(tail, count)))
            change = np.append(True, (part[1:] != part[:-1]) | (line[1:] != line[:-1]))
            cut = np.flatnonzero(change)
            sums, of, size = np.add.reduceat(term, cut), np.repeat(np.arange(len(begin)), count)[cut], np.diff(np.append(cut, len(h)))
            all_, n = np.add.reduceat(term, begin), count.astype(np.uint64)
            exact = H.mix(all_ + n * H.constant("exact"))
            wide = np.flatnonzero((part[cut] >= 0) & (count[of] - size >= AGREE))
            merged = H.mix(H.mix(all_[of[wide]] - sums[wide]) + n[of[wide]] * H.constant("merged") + part[cut[wide]].astype(np.uint64))
        own = doc[begin]
        number = np.searchsorted(newlines, starts[begin]) - np.searchsorted(newlines, offset[own])
        use = np.flatnonzero(count >= SHORT)
        rows = np.concatenate([use, of[wide]])
        parts.append((own[rows] + a, number[rows], np.concatenate([exact[use], merged])))
    if not parts:
        return tuple(np.empty(0, dtype=t) for t in (np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def known_keys(keys: DataFrame, most_keys: int) -> np.ndarray | None:
    """The sorted keys, to be sent to every task; None if there are more than ``most_keys``."""
    return np.sort(np.asarray(keys.toArrow()["key"], dtype=np.int64)) if keys.count() <= most_keys else None


def recurring(docs: DataFrame, recur: int, most_keys: int = MOST_KEYS) -> DataFrame:
    """(key) of the templates that texts of ``recur`` near-duplicate classes hold; docs: (th, text).

    A text counts once, whatever it repeats and however many documents are copies of it.  Occurrences are
    counted first, pre-aggregated; only templates with ``recur`` of them, and then in as many different
    texts, and only the texts that hold these, are looked at further.  Classes are those of texts linked
    with the hubs of their buckets.
    """

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, _, key = templates(texts_of(batch.column(1)))
            order = np.lexsort((key, text))
            text, key = text[order], key[order]
            once = np.append(True, (text[1:] != text[:-1]) | (key[1:] != key[:-1]))[: len(text)]
            text, key = text[once], key[once].astype(np.int64)
            ends = np.searchsorted(text, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(key))], names=["th", "keys"])

    # the templates of each text, hashed once
    forms = materialize(docs.select("th", "text").mapInArrow(form, "th long, keys array<long>"), "forms")
    often = forms.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where(f"n >= {recur}").select("key")
    keys = materialize(often, "often")
    known = known_keys(keys, most_keys)
    if known is not None and not len(known):
        return keys

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            key = np.asarray(lists.flatten())
            hit = np.flatnonzero(_among(key, known))
            text = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths()))[hit]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), pa.array(key[hit])], names=["th", "key"])

    held = forms.mapInArrow(hold, "th long, key long") if known is not None else forms.select("th", F.explode("keys").alias("key")).join(keys, "key", "left_semi")
    held = materialize(held.select("th", "key").distinct(), "held")
    discard(forms)
    enough = held.groupBy("key").agg(F.count("*").alias("n")).where(f"n >= {recur}").select("key")
    few = materialize(held.join(enough, "key", "left_semi"), "held")
    discard(keys, held)
    if few.isEmpty():
        return few.select("key")
    texts = docs.select("th", "text").join(few.select("th").distinct(), "th", "left_semi").dropDuplicates(["th"])
    texts = materialize(texts, "texts")
    classes = near_duplicates(texts, id_col="th", by_hubs=True, bands=CLASS_BANDS).select(F.col("doc_id").alias("th"), "component_id")
    out = few.join(classes, "th").select("key", "component_id").distinct().groupBy("key").agg(F.count("*").alias("n"))
    out = materialize(out.where(f"n >= {recur}").select("key"), "recurring")
    discard(few, texts)
    return out


def _among(key: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are among the known, sorted ones."""
    if not len(known):
        return np.zeros(len(key), dtype=bool)
    return known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key


def drop_recurring(documents: DataFrame, recur: int = RECUR, most_keys: int = MOST_KEYS, whole: bool = False) -> DataFrame:
    """The columns of documents (doc_id, text and any others), with the text's remaining lines, and
    n_lines and n_dropped.

    A null text stays null with no lines; a text without recurring lines stays as it is.  Rows that
    repeat an id and a text get the same result each.  Up to ``most_keys`` recurring templates go to
    every task; more are joined to the lines.  Both ways give the same rows.  With ``whole`` a text that
    would keep nothing but white space stays as it is, with n_dropped 0, so that no document is lost.
    """
    names = documents.drop("n_lines", "n_dropped").columns
    docs = documents.select(*(F.col(f"`{c}`") for c in names)).toDF(*(f"c{i}" for i in range(len(names))))
    at = names.index("text")
    docs = docs.withColumn("id", F.col(f"c{names.index('doc_id')}").cast("long")).withColumn("th", F.xxhash64(f"c{at}"))
    often = recurring(docs.select("th", F.col(f"c{at}").alias("text")), recur, most_keys)
    known = known_keys(often, most_keys)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, line, key = templates(texts_of(batch.column(2)))
            ids = pa.array(text)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(ids), batch.column(1).take(ids), pa.array(line.astype(np.int32)), pa.array(key.astype(np.int64))], names=["id2", "th2", "line", "key"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            if known is None:
                gone = [set(x or ()) for x in batch.column(1).to_pylist()]
            else:
                gone = [set() for _ in texts]
                text, line, key = templates([t or b"" for t in texts])
                hit = np.flatnonzero(_among(key.astype(np.int64), known))
                for i, k in zip(text[hit].tolist(), line[hit].tolist(), strict=True):
                    gone[i].add(k)
            n = [0 if t is None else t.count(b"\n") + 1 for t in texts]
            out = [b"\n".join([x for i, x in enumerate(t.split(b"\n")) if i not in g]) if g else t for t, g in zip(texts, gone, strict=True)]
            if whole:
                gone = [set() if g and t and not o.strip(_BLANK) else g for g, t, o in zip(gone, texts, out, strict=True)]
                out = [o if g else t for o, t, g in zip(out, texts, gone, strict=True)]
            dropped = [len(g) for g in gone]
            changed = [i for i, g in enumerate(gone) if g]
            at = np.arange(batch.num_rows)
            at[changed] = batch.num_rows + np.arange(len(changed))
            kept = pa.concat_arrays([batch.column(0).cast(pa.string()), pa.array([out[i].decode() for i in changed], pa.string())]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], kept, pa.array(n, pa.int64()), pa.array(dropped, pa.int64())], names=[*batch.schema.names[2:], "text", "n_lines", "n_dropped"])

    if known is not None:
        docs = docs.withColumn("gone", F.lit(None).cast("array<int>"))
    else:
        found = docs.select("id", "th", F.col(f"c{at}").alias("text")).mapInArrow(emit, "id2 long, th2 long, line int, key long")
        gone = found.join(often, "key").groupBy("id2", "th2").agg(F.collect_set("line").alias("gone"))
        docs = docs.join(gone, F.expr("id <=> id2 and th = th2"), "left")
    other = [f"c{i}" for i in range(len(names)) if i != at]
    full = docs.select(F.col(f"c{at}").alias("text"), "gone", *other)
    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in other)
    out = full.mapInArrow(keep, f"{schema}, text string, n_lines long, n_dropped long")
    return out.select(*(F.col("text" if i == at else f"c{i}") for i in range(len(names))), "n_lines", "n_dropped").toDF(*names, "n_lines", "n_dropped")


def op4_lines(spark, sf_dir) -> DataFrame:
    """All documents without recurring lines, as digests."""
    out = drop_recurring(by_column(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
