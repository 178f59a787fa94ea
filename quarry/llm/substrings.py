"""Substring dedup (operator 5): prefix-partitioned suffix trees over repeated windows of words.

A window is W consecutive words of one document; the suffixes that matter are those that start one.  Of
the K-word prefixes inside a window the one with the least hash is its anchor, so equal windows have equal
anchors.  Anchors whose K words occur once in all documents cannot lie in a repeated window and are
dropped.  The other anchors partition the suffixes by a prefix of K words: a partition holds for each of
its anchors the words around it, equal surroundings once with their number.

A partition of more than GROUP different surroundings is split by longer prefixes: windows that start
near each other before an anchor share more words than the anchor's, so its windows are divided into
bands of neighbouring starts, each half as wide as before, and the surroundings by the words that all
windows of a band share, until what shares them fits into memory.  Surroundings that are equal as far as
a band reaches are repeats and go on as one.  In a partition that fits, the suffixes are sorted by their
words and the longest common prefixes of neighbours give the inner nodes of their tree; a suffix below a
node that is W words deep or more starts a repeated window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import wordhash as H
from quarry.llm.common import by_column, discard, materialize, texts_of

#: Words in an anchor, and the most different surroundings of one prefix that a tree is built of.
K, GROUP = 12, 256
_SEGMENT = 1 << 19
_MASK = np.uint64((1 << 20) - 1)


def _anchors(g: np.ndarray, valid: np.ndarray, spread: int) -> np.ndarray:
    """For each window start in valid: the position of the least of spread prefixes from there."""
    packed = (g & ~_MASK) | np.arange(len(g), dtype=np.uint64)
    width, least = 1, packed
    while 2 * width <= spread:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    if width < spread:
        least = np.minimum(least[: len(least) - (spread - width)], least[spread - width :])
    return (least[valid] & _MASK).astype(np.int64)


def window_anchors(h: np.ndarray, first: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix hashes, window starts and each window's anchor, for texts joined in h (see words())."""
    g = H.shingles(h, k)
    sizes = np.diff(first)
    count = np.maximum(0, sizes - window + 1)
    starts = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    found = np.empty(len(starts), dtype=np.int64)
    for a in range(0, len(h), _SEGMENT):  # more than one for a huge text only
        lo, hi = np.searchsorted(starts, [a, a + _SEGMENT])
        if lo < hi:
            found[lo:hi] = _anchors(g[a : a + _SEGMENT + window], starts[lo:hi] - a, window - k + 1) + a
    return g, starts, found


def _lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def tree(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix tree of some suffixes (a row of word hashes each): their order as leaves, and the depth of
    the lowest inner node above each leaf and the next."""
    _, rank = np.unique(words, return_inverse=True)
    rank = rank.reshape(words.shape).astype(np.uint64)
    bits = max(1, int(rank.max(initial=0)).bit_length())
    some, keys = 64 // bits, []
    for i in range(0, words.shape[1], some):  # several words in a sort key
        key = np.zeros(len(words), dtype=np.uint64)
        for j in range(i, min(i + some, words.shape[1])):
            key = (key << np.uint64(bits)) | rank[:, j]
        keys.append(key)
    order = np.lexsort(keys[::-1])
    same = rank[order[1:]] == rank[order[:-1]]
    return order, np.where(same.all(axis=1), words.shape[1], np.argmin(same, axis=1))


def deep_leaves(words: np.ndarray, path: np.ndarray) -> np.ndarray:
    """Which suffixes lie below an inner node as deep as the rows are long.

    path: a hash of each row; a suffix whose hash no other has cannot, and stays out of the tree.
    """
    _, of, n = np.unique(path, return_inverse=True, return_counts=True)
    some = np.flatnonzero(n[of] > 1)
    deep = np.zeros(len(words), dtype=bool)
    if len(some):
        order, depth = tree(words[some])
        node = np.flatnonzero(depth == words.shape[1])
        deep[some[order[node]]] = deep[some[order[node + 1]]] = True
    return deep


def repeated_windows(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, th, pos, mask) lists of anchors in each text with the repeated windows around them.

    docs: (doc_id, th, text) with th a hash of the text.  Bit l of a mask stands for the window that
    starts l words before pos.
    """
    left, k = window - K, K

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(2))
            for a, b in H.blocks(texts):
                _, _, _, h, first = H.words(texts[a:b])
                g, _, found = window_anchors(h, first, window, k)
                at = np.unique(found)
                row = np.searchsorted(first, at, side="right") - 1
                order = np.lexsort((at, g[at], row))
                at, row = at[order], row[order]
                key = g[at]
                begin = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (row[1:] != row[:-1]))) if len(at) else np.empty(0, dtype=np.int64)
                ids = pa.array(row[begin] + a)
                pos = _lists((at - first[row]).astype(np.int32), np.append(begin, len(at)), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(key[begin].astype(np.int64)), batch.column(0).take(ids), batch.column(1).take(ids), pos], names=["key", "doc_id", "th", "pos"])

    # a text's anchors of the same words are one row, however often a text repeats itself
    anchors = materialize(docs.mapInArrow(find, "key long, doc_id long, th long, pos array<int>"), "anchors")
    # written, so that the join reads two plain exchanges, of which Spark can split a frequent key's
    twice = materialize(anchors.groupBy("key").agg(F.sum(F.size("pos")).alias("n")).where("n > 1").select("key"), "twice")
    held = anchors.join(twice, "key").groupBy("doc_id", "th").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("pos")))).alias("at"))
    held = materialize(held, "held")
    discard(anchors, twice)

    def surround(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "th", "pos", "key", "ca", "cb", "nl", "own", "words"]
        for batch in batches:
            texts, seen = texts_of(batch.column(2)), np.empty(0, dtype=np.int64)
            for a, b in H.blocks(texts):
                buf, starts, ends, h, first = H.words(texts[a:b])
                g, begin, found = window_anchors(h, first, window, k)
                lists = batch.column(3).slice(a, b - a)
                sizes = np.asarray(lists.value_lengths())
                row = np.repeat(np.arange(b - a), sizes)
                at = np.asarray(lists.flatten()).astype(np.int64) + first[row]
                own = np.zeros(len(h) + 1, dtype=np.int64)  # windows whose anchor a position is
                np.bitwise_or.at(own, found, np.int64(1) << (found - begin))
                lo, hi = np.maximum(first[row], at - left), np.minimum(first[row + 1], at + window)
                with np.errstate(over="ignore"):
                    prints = []
                    for name in "ab":
                        total = (hi - lo).astype(np.uint64) * H.constant(f"around {name}") + (at - lo).astype(np.uint64)
                        for j in range(-left, window):
                            p = at + j
                            inside = (p >= lo) & (p < hi)
                            total = total + np.where(inside, h[np.where(inside, p, 0)], H.U64(0)) * H.constant(f"around {name} {j}")
                        prints.append(H.mix(total).astype(np.int64))
                _, once = np.unique(prints[0], return_index=True)
                once = once[~np.isin(prints[0][once], seen)]
                if len(seen) < 1 << 18:
                    seen = np.concatenate([seen, prints[0][once]])
                words = np.full(len(at), None, dtype=object)
                data = buf.tobytes()
                for i in once.tolist():
                    words[i] = data[starts[lo[i]] : ends[hi[i] - 1]]
                ids = pa.array(row + a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(ids), batch.column(1).take(ids), pa.array((at - first[row]).astype(np.int32)), pa.array(g[at].astype(np.int64)), *map(pa.array, prints), pa.array((at - lo).astype(np.int32)), pa.array(own[at].astype(np.int32)), pa.array(words, pa.binary())], names=names
                )

    around = docs.join(held, ["doc_id", "th"]).select("doc_id", "th", "text", "at")
    around = materialize(around.mapInArrow(surround, "doc_id long, th long, pos int, key long, ca long, cb long, nl int, own int, words binary"), "around")
    discard(held)
    leaves = around.groupBy("ca", "cb").agg(F.min("key").alias("key"), F.min("nl").alias("nl"), F.max("own").alias("own"), F.max("words").alias("words"), F.count("*").alias("n"))
    leaves = materialize(leaves, "leaves")
    sizes = leaves.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    several = leaves.where("own <> 0").join(sizes, "key")

    def matrix(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word hashes around each anchor (column ``left``), 0 beyond the text; number; own windows."""
        nl = np.asarray(batch.column("nl"))
        _, _, _, h, first = H.words(batch.column("words").to_pylist())
        m = np.zeros((len(nl), left + window), dtype=np.uint64)
        row = np.repeat(np.arange(len(nl)), np.diff(first))
        m[row, np.arange(len(h)) - first[row] + (left - nl)[row]] = h
        return m, np.asarray(batch.column("n")), np.asarray(batch.column("own"))

    def suffixes(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and l of each window whose anchor a surrounding's is."""
        at, row = np.nonzero((own[None, :] >> np.arange(left + 1)[:, None]) & 1)
        return row, at

    def paths(words: np.ndarray, length: int, name: str) -> np.ndarray:
        """A hash of the first words of each suffix."""
        with np.errstate(over="ignore"):
            total = np.zeros(len(words), dtype=np.uint64)
            for j in range(length):
                total += words[:, j] * H.constant(f"path {name} {j}")
        return H.mix(total)

    def marked(m: np.ndarray, table: pa.Table) -> pa.RecordBatch:
        """Masks of the windows below a deep node of the tree of all own windows of some surroundings."""
        n, own = np.asarray(table["n"]), np.asarray(table["own"])
        row, at = suffixes(own)
        path = np.empty(len(row), dtype=np.uint64)
        cuts = np.searchsorted(at, np.arange(left + 2))
        for l in range(left + 1):
            some = slice(cuts[l], cuts[l + 1])
            path[some] = paths(m[row[some], left - l : left - l + window], window, "a")
        _, of, count = np.unique(path, return_inverse=True, return_counts=True)
        some = np.flatnonzero(count[of] > 1)
        deep = n[row] > 1
        deep[some] |= deep_leaves(m[row[some][:, None], (left - at[some])[:, None] + np.arange(window)], path[some])
        mask = np.zeros(table.num_rows, dtype=np.int64)
        np.bitwise_or.at(mask, row[deep], np.int64(1) << at[deep])
        return pa.RecordBatch.from_arrays([table["ca"].combine_chunks(), table["cb"].combine_chunks(), pa.array(mask.astype(np.int32))], names=["ca", "cb", "mask"])

    def below(table: pa.Table) -> pa.RecordBatch:
        return marked(matrix(table)[0], table)

    def bands(width: int, whole: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Rows of surroundings (ca, cb, low, own, n, around) for each band of ``width`` starts in theirs of
        ``whole``, with hashes of the words that its windows share, and of all that they reach."""

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, 512):
                    part = batch.slice(i, 512)
                    m = np.frombuffer(b"".join(part.column("around").to_pylist()), dtype=np.uint64).reshape(-1, left + window)
                    own, first = np.asarray(part.column("own")).astype(np.int64), np.asarray(part.column("low"))
                    for low in np.unique(first).tolist():
                        for l in range(low, min(low + whole, left + 1), width):
                            high = min(l + width, low + whole, left + 1) - 1
                            bits = own & (((1 << (high - l + 1)) - 1) << l)
                            rows = np.flatnonzero((first == low) & (bits != 0))
                            shared, reach = m[rows, left - l : left + window - high], m[rows, left - high : left + window - l]
                            ids, salt = pa.array(rows), H.constant(f"band {l} {high}")
                            prints = [H.mix(paths(x, x.shape[1], name) ^ salt).astype(np.int64) for x, name in ((shared, "a"), (reach, "a"), (reach, "b"))]
                            yield pa.RecordBatch.from_arrays([part.column("ca").take(ids), part.column("cb").take(ids), pa.array(np.full(len(rows), l, dtype=np.int32)), pa.array(bits[rows].astype(np.int32)), part.column("n").take(ids), part.column("around").take(ids), *map(pa.array, prints)], names=["ca", "cb", "low", "own", "n", "around", "p", "ea", "eb"])

        return split

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                m, n, own = matrix(part)
                yield pa.RecordBatch.from_arrays([part.column("ca"), part.column("cb"), pa.array(np.zeros(len(n), dtype=np.int32)), part.column("own"), pa.array(n), pa.array([r.tobytes() for r in m], pa.binary())], names=["ca", "cb", "low", "own", "n", "around"])

    def below_bands(table: pa.Table) -> pa.RecordBatch:
        return marked(np.frombuffer(b"".join(table["around"].to_pylist()), dtype=np.uint64).reshape(-1, left + window), table)

    columns, row = ["key", "ca", "cb", "nl", "own", "words", "n"], "ca long, cb long, low int, own int, n long, around binary"
    masks = _by_group(several.where(f"size <= {GROUP}").select(columns), "key", below)
    wide, rest, made = left + 1, several.where(f"size > {GROUP}").select(columns), []
    while wide > 1:
        narrow = 1 if wide <= 3 else -(-wide // 2)
        cut = bands(narrow, wide)
        banded = rest.mapInArrow(cut if made else lambda batches, cut=cut: cut(whole(batches)), f"{row}, p long, ea long, eb long")
        banded = materialize(banded, "bands")
        made.append(banded)
        if banded.isEmpty():
            break
        # surroundings that are equal as far as the band reaches go on as one
        folded = materialize(banded.groupBy("ea", "eb").agg(F.sum("n").alias("n"), F.first(F.struct("ca", "cb", "low", "own", "around", "p")).alias("r")), "folded")
        equal = folded.where("n > 1").select("ea", "eb")
        masks = masks.unionByName(banded.join(equal, ["ea", "eb"]).select("ca", "cb", F.col("own").alias("mask")))
        made.append(folded)
        if (wide := narrow) > 1:
            other = folded.select("r.*", "n")
            sizes = materialize(other.groupBy("p").agg(F.count("*").alias("size")).where("size > 1"), "prefixes")
            made.append(sizes)
            grouped = other.join(sizes, "p")
            masks = masks.unionByName(_by_group(grouped.where(f"size <= {GROUP}").select("p", "ca", "cb", "own", "n", "around"), "p", below_bands))
            rest = grouped.where(f"size > {GROUP}").select("ca", "cb", "low", "own", "n", "around")
    masks = masks.unionByName(leaves.where("n > 1 and own <> 0").select("ca", "cb", F.col("own").alias("mask")))
    masks = materialize(masks.where("mask <> 0").groupBy("ca", "cb").agg(F.bit_or("mask").alias("mask")), "masks")
    hits = around.select("doc_id", "th", "pos", "ca", "cb").join(masks, ["ca", "cb"])
    out = materialize(hits.groupBy("doc_id", "th").agg(F.collect_set(F.struct("pos", "mask")).alias("hits")), "hits")
    discard(leaves, *made, around, masks)
    return out


def _by_group(rows: DataFrame, key: str, below: Callable[[pa.Table], pa.RecordBatch], least: int = 2048) -> DataFrame:
    """(ca, cb, mask) of below() over whole groups of a key, some groups at a time."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < least:
                continue
            table = pa.Table.from_batches(held)
            keys = np.asarray(table[key])
            cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if (keys != keys[-1]).any() else 0
            for i, j in _runs(keys[:cut], least):
                yield below(table.slice(i, j - i))
            held = table.slice(cut).to_batches()
        if sum(b.num_rows for b in held):
            table = pa.Table.from_batches(held)
            for i, j in _runs(np.asarray(table[key]), least):
                yield below(table.slice(i, j - i))

    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(apply, "ca long, cb long, mask int")


def _runs(keys: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Ranges of at least that many rows (but the last) that end with a key's last row."""
    ends = np.flatnonzero(np.append(keys[1:] != keys[:-1], True)) + 1 if len(keys) else []
    out, begin = [], 0
    for e in ends:
        if e - begin >= least or e == len(keys):
            out.append((begin, int(e)))
            begin = int(e)
    return out


def remove_repeats(documents: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every row with its words outside repeated windows.

    Words are unchanged; ``kept`` joins them by one space.  A null text has no words.  Windows are judged
    on the input: of a text that occurs twice (two rows, or one row's id and text repeated) nothing of
    its windows stays.  Texts of fewer than ``window`` words stay.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), F.xxhash64("text").alias("th"), F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").isNull().alias("no_id"))
    hits = repeated_windows(docs.select("doc_id", "th", "text"), window)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in H.blocks(texts):
                data = [t.split() for t in texts[a:b]]
                n, removed, kept = [], [], []
                for words, pos, mask in zip(data, batch.column(2).slice(a, b - a), batch.column(3).slice(a, b - a), strict=True):
                    gone = np.zeros(len(words) + 1, dtype=np.int64)
                    if pos.is_valid:
                        p, m = np.asarray(pos.values), np.asarray(mask.values)
                        for l in range(window - K + 1):
                            at = p[(m >> l) & 1 == 1] - l
                            np.add.at(gone, at, 1)
                            np.add.at(gone, at + window, -1)
                    out = np.cumsum(gone)[:-1] > 0
                    n.append(len(words))
                    removed.append(int(out.sum()))
                    kept.append(b" ".join(words) if not removed[-1] else b" ".join([w for w, o in zip(words, out.tolist(), strict=True) if not o]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array([x.decode() for x in kept], pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    full = docs.join(hits, ["doc_id", "th"], "left").select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "text", F.col("hits.pos").alias("pos"), F.col("hits.mask").alias("mask"))
    return full.mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept string")


def op5_substrings(spark, sf_dir) -> DataFrame:
    """All documents without the words of repeated 35-word windows, as digests."""
    out = remove_repeats(by_column(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def sha256(words: list[bytes]) -> str:
    """The digest of kept words, for tests."""
    return hashlib.sha256(b" ".join(words)).hexdigest()


ORACLE_SQL = r"""
with docs as (select row_number() over () as row, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
windows as (select row, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) as h from docs, unnest(range(1, len(w) - 33)) as t(i) where len(w) >= 35),
repeated as (select h from windows group by h having count(*) > 1),
gone as (select distinct row, i + k as i from windows join repeated using (h), range(35) as r(k)),
words as (select row, i, w[i] as word from docs, unnest(range(1, len(w) + 1)) as t(i)),
kept as (select row, string_agg(word, ' ' order by i) as kept, count(*) as n from words anti join gone using (row, i) group by 1)
select doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from docs left join kept using (row)
"""
