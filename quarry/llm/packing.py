"""Packing of tokenized documents into fixed-length training sequences (operator 8).

Documents are tokenized, given an end token, and cut into pieces of at most ``length`` tokens at
multiples of it.  Pieces are packed by first-fit decreasing with a tournament tree over the bins'
free space, independently in randomised groups of documents.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import wordhash as H
from quarry.llm.common import by_column, materialize, texts_of

#: Words in a worker's memory, which begins anew when it is full.  Bounds memory, not results.
CACHE_WORDS = 500_000
#: Bins in one group's numbering.
GROUP_BINS = 1 << 32
# Fixed value: the split of a vocabulary whose tokens never cross white space and for which letters,
# and marks after letters, are tokens of their own.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Lower-case letters that no normalisation changes: ASCII and those of Latin-1.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
_MARK = np.zeros(256, dtype=bool)
_MARK[list(b".,;:!?%#*&$)")] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _gather(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The values flat[start : start + count] of each range, joined."""
    before = np.cumsum(count) - count
    return flat[np.repeat(start - before, count) + np.arange(int(count.sum()))]


class Encoder:
    """Token ids of texts.

    With the SPLIT above a text's ids are those of its words in turn, a word's last marks apart, and
    letters' case makes no difference.  All words of a block are hashed at once and looked up in an open
    hash table, whose entries hold the words' bytes and ids; a block's bytes are compared with those of
    the entries found, so that equal hashes of different words do no harm.  Only words that are not
    there yet are tokenized.  Texts under any other vocabulary are tokenized as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        config = json.loads(self.tokenizer.to_str())
        kinds = [n["type"] for n in (config["normalizer"] or {}).get("normalizers", [])]
        splits = [p.get("pattern") for p in (config["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"]
        marked = all("<|" in t["content"] for t in config["added_tokens"])
        self.by_words = marked and sorted(kinds) == ["Lowercase", "NFC", "Replace"] and splits == [{"Regex": SPLIT}] and config["post_processor"] is None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level form: these bytes are themselves
        self.byte_level = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
        self._clear()

    def _clear(self) -> None:
        self.n, self.bits = 0, 21
        self.slots = np.full(1 << self.bits, -1, dtype=np.int32)
        self.hash = np.zeros(CACHE_WORDS + (1 << 19), dtype=np.uint64)
        self.place = np.zeros((4, len(self.hash)), dtype=np.int64)  # start and length of bytes, of ids
        self.bytes, self.ids = np.zeros(1 << 20, dtype=np.uint8), np.zeros(1 << 20, dtype=np.uint32)
        self.used = [0, 0]

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each hash, or -1."""
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        found = self.slots[slot]
        open_ = np.flatnonzero((found >= 0) & (self.hash[found] != h))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            found[open_] = self.slots[slot[open_]]
            open_ = open_[(found[open_] >= 0) & (self.hash[found[open_]] != h[open_])]
        return found

    def _add(self, h: np.ndarray, words: list[bytes]) -> None:
        ids = self._encoded(words)
        entry = np.arange(self.n, self.n + len(words))
        self.n += len(words)
        self.hash[entry] = h
        for k, (name, flat, sizes) in enumerate((("bytes", np.frombuffer(b"".join(words), dtype=np.uint8), [len(w) for w in words]), ("ids", np.array([i for x in ids for i in x], dtype=np.uint32), [len(x) for x in ids]))):
            begin, sizes = self.used[k], np.array(sizes, dtype=np.int64)
            held = getattr(self, name)
            if begin + len(flat) > len(held):
                held = np.concatenate([held, np.zeros(len(held) + len(flat), dtype=held.dtype)])
                setattr(self, name, held)
            held[begin : begin + len(flat)] = flat
            self.place[2 * k, entry], self.place[2 * k + 1, entry] = begin + np.cumsum(sizes) - sizes, sizes
            self.used[k] += len(flat)
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(entry):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = entry[free]
            lost = self.slots[slot] != entry
            entry, slot = entry[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)

    def _encoded(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word; words of plain letters go to the model at once, in byte-level form."""
        tokenize, table, letters = self.tokenizer.model.tokenize, self.byte_level, _LETTERS.fullmatch
        out = [[t.id for t in tokenize(w.decode() if w.isascii() else w.decode("latin-1").translate(table))] if letters(w) else None for w in words]
        other = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(other, self._texts([words[i] for i in other]), strict=True):
            out[i] = ids
        return out

    def _texts(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def encode(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by end_id, and the number of them up to each text's end."""
        if not self.by_words:
            return self._plain(texts, end_id)
        joined = b" ".join(texts) + b" "
        if b"<|" not in joined:  # bytes: A-Z only; the strings of special tokens are told by case
            joined = joined.lower()
        buf = np.frombuffer(joined, dtype=np.uint8)
        starts, ends = H.spans(buf)
        last = np.maximum.accumulate(np.where(_MARK[buf], -1, np.arange(len(buf))))  # the last byte that is no mark
        tail = last[ends - 1] + 1
        tail = tail[(tail > starts) & (tail < ends) & _LETTER[buf[tail - 1]]]
        starts, ends = np.sort(np.concatenate([starts, tail]), kind="stable"), np.sort(np.concatenate([ends, tail]), kind="stable")
        h = H.hash_spans(buf, starts, ends)
        size = np.cumsum([len(t) + 1 for t in texts])
        first = np.searchsorted(starts, size)
        entry = self._find(h)
        new = np.flatnonzero(entry < 0)
        if len(new):
            unknown, at = np.unique(h[new], return_index=True)
            if self.n + len(unknown) > CACHE_WORDS and self.n:
                self._clear()
                return self.encode(texts, end_id)
            if self.n + len(unknown) > len(self.hash):  # one text of more new words than the memory holds
                return self._plain(texts, end_id)
            at = new[at]
            self._add(unknown, [joined[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            entry[new] = self._find(h[new])
        place = self.place[:, entry]
        if not (np.array_equal(place[1], ends - starts) and np.array_equal(_gather(self.bytes, place[0], place[1]), buf[~H.is_space(buf)])):
            return self._plain(texts, end_id)
        count = np.concatenate([[0], np.cumsum(place[3])])[first]
        ids = np.insert(_gather(self.ids, place[2], place[3]), count, np.uint32(end_id))
        return ids, count + np.arange(1, len(texts) + 1)

    def _plain(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.array([*x, end_id], dtype=np.uint32) for x in self._texts(texts)]
        return np.concatenate(ids), np.cumsum([len(x) for x in ids])


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each worker process, kept over its tasks."""
    return Encoder(path)


def pieces(docs: DataFrame, vocabulary: str, end_id: int = 1, length: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Tokenized pieces: id, start, length, ids_crc32, doc_tokens, document and (with_ids) the ids themselves.

    A null or empty text has the end token alone.  Repeated ids of documents are separate documents:
    ``document`` is a number drawn by a hash of id and content, equal in a row's pieces; rows of a
    partition that are equal in both have different ones.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, document long" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, seen, partition = encoder(vocabulary).encode, Counter(), TaskContext.get().partitionId()
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in H.blocks(texts):
                ids, ends = encode(texts[a:b], end_id)
                sizes = np.diff(ends, prepend=0)
                count = -(-sizes // length)
                row = np.repeat(np.arange(b - a), count)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * length
                lo = (ends - sizes)[row] + start
                hi = np.minimum(lo + length, ends[row])
                data = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * x : 4 * y]) for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
                names = np.asarray(batch.column(0).slice(a, b - a).fill_null(-1)).astype(np.uint64)
                with np.errstate(over="ignore"):
                    parts = H.mix(np.array(crc, dtype=np.uint64) + start.astype(np.uint64) * H.constant("start"))
                    drawn = H.mix(names * H.constant("name") + np.add.reduceat(parts, np.cumsum(count) - count))
                for i, x in enumerate(drawn.tolist()):
                    if seen[x]:
                        drawn[i] = H.mix(drawn[i : i + 1] ^ np.uint64(partition << 40 | seen[x]))[0]
                    seen[x] += 1
                document = drawn[row].astype(np.int64)
                columns = [batch.column(0).take(pa.array(row + a)), *(pa.array(x, pa.int64()) for x in (start, hi - lo, crc, sizes[row], document))]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(lo, len(ids)), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "document", "ids"][: len(columns)])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, schema)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece: longest first (ties by position), into the first bin that has room.

    Bins are the leaves of a tournament tree whose inner nodes hold the most free space below.
    """
    n = len(lengths)
    order = np.argsort(-lengths, kind="stable")
    whole = int((lengths == capacity).sum())  # the longest fill a bin each
    size = 1 << max(0, (n - whole - 1).bit_length())
    free = [capacity] * (2 * size)
    bins, offsets = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    bins[order[:whole]] = np.arange(whole)
    for i in order[whole:].tolist():
        need, node = int(lengths[i]), 1
        while node < size:
            node *= 2
            if free[node] < need:
                node += 1
        bins[i], offsets[i] = whole + node - size, capacity - free[node]
        free[node] -= need
        while node > 1:
            node //= 2
            best = max(free[2 * node], free[2 * node + 1])
            if free[node] == best:
                break
            free[node] = best
    return bins, offsets


def pack(cut: DataFrame, length: int = 2048, group_docs: int = 2000, seed: int = 1) -> DataFrame:
    """Adds sequence_id and offset to pieces.

    Groups are drawn by a hash of a document's number and seed, about ``group_docs`` documents each, so
    no group grows with the input, whatever its order, its sources or repeated ids.
    """
    cut = cut.withColumn("_key", F.xxhash64(F.lit(seed), "document"))
    groups = max(1, round(cut.where("start = 0").count() / group_docs))

    def place(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["document", "start"], kind="stable")
        bins, offsets = first_fit_decreasing(part["length"].to_numpy(), length)
        return part.assign(sequence_id=part["_group"] * GROUP_BINS + bins, offset=offsets)

    columns = [c for c in cut.columns if c not in ("_key", "document")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.select(columns).schema)
    grouped = cut.withColumn("_group", F.pmod(F.col("_key"), F.lit(groups))).drop("_key")
    return grouped.groupBy("_group").applyInPandas(lambda p: place(p).drop(columns=["_group", "document"]), f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame, length: int = 2048, pad_id: int = 0) -> DataFrame:
    """Training sequences: sequence_id, ids, n_tokens and the padding; one row has at most ``length`` ids.

    A sequence is padded to ``length`` unless its own length is a power of two.
    """
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    ids = F.flatten(F.col("parts.ids"))
    out = parts.select("sequence_id", ids.alias("ids")).withColumn("n_tokens", F.size("ids"))
    power: Column = F.bit_count("n_tokens") == 1
    padding = F.when(power, 0).otherwise(length - F.col("n_tokens"))
    return out.withColumn("padding", padding).withColumn("ids", F.concat("ids", F.array_repeat(F.lit(pad_id), F.col("padding").cast("int"))))


def vocabulary_path() -> str:
    """The default vocabulary file of the query."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_packing(spark, sf_dir) -> DataFrame:
    """All documents as pieces of at most 2048 tokens, packed."""
    return pack_documents(by_column(spark, sf_dir, "documents"))


def pack_documents(docs: DataFrame, vocabulary: str | None = None, length: int = 2048) -> DataFrame:
    """Pieces of all documents with their place; the tokenized table is written once."""
    cut = materialize(pieces(docs, vocabulary or vocabulary_path(), length=length, with_ids=False), "pieces")
    return pack(cut, length)
