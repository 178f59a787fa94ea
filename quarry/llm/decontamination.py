"""Benchmark decontamination (operator 9): BM25 over test items, block-max WAND, overlap checks.

The test items are the indexed documents and every passage of a training document is a query.  An item's
threshold is a share of its own score or of its question's, whichever is less, and never above what a
passage that passes the check can score.  Items are numbered by rising threshold, so that the threshold
that WAND needs at an item holds for all behind it.  A term's postings lie in blocks with their largest
weight.  A passage's cursors move through the postings of its terms: the pivot is the first item where
the lists' largest weights, in order of their cursors, reach the threshold; the maxima of the blocks
around it decide whether it is scored or all items up to the end of a block are skipped.

Most passages never come so far.  Of each item the terms of largest weight are essential: what is left
of it scores half of its threshold at most.  The essential postings of all passages of a batch are summed
at once, and only passages whose sum leaves room for an item enter the loop, so nothing is lost.  What
is retrieved is verified by the share of the item's question and answer that occurs in the document in
five-word shingles.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from quarry.llm import wordhash as H
from quarry.llm.common import by_column, texts_of

#: Items in one index; more are indexed and scanned for in several turns, which bounds the broadcast.
#: Postings in a block, BM25's constants, and the least words of a chunk.
MAX_ITEMS = 20_000
BLOCK, K1, B = 16, 1.2, 0.75
#: Words of an item up to which its threshold follows the places of words; beyond, it is a lower one.
LONGEST = 256
STRIDE = 64
_PLAIN = bytes(32 if chr(i) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else i for i in range(256))


def plain(text: bytes) -> bytes:
    """Punctuation as white space."""
    return text.translate(_PLAIN)


def _heaviest(weights: list[float], lacking: int, size: int) -> float:
    """The most weight of words that a text can lack of a sequence if at most ``lacking`` of its shingles
    of ``size`` words are missing: a word lacks the shingles that hold it."""
    n = len(weights)
    best = {(0, -size): 0.0}  # (missing, last word that is lacking)
    for i, w in enumerate(weights):
        more: dict[tuple[int, int], float] = {}
        for (k, last), total in best.items():
            lo, hi = max(0, i - size + 1, min(last, n - size) + 1), min(i, n - size)
            if (cost := k + max(0, hi - lo + 1)) <= lacking and more.get((cost, i), -1.0) < total + w:
                more[cost, i] = total + w
            if more.get((k, last if i - last < size else -size), -1.0) < total:
                more[k, last if i - last < size else -size] = total
        best = more
    return max(best.values())


class Index:
    """Postings of the items' terms with block maxima, and the shingles of question and answer.

    ``seen`` counts what search() did: passages, those that entered the loop, postings of their terms and
    the postings that were scored.
    """

    def __init__(self, items: list[tuple[int, str, str]], share: float = 0.75, words: int = 5, overlap: float = 0.8):
        self.words, self.seen = words, Counter()
        texts = [[plain(t.encode()) for t in (q, a, f"{q} {a}")] for _, q, a in items]
        hashes = [[self._words(t) for t in x] for x in texts]
        self.terms = np.unique(np.concatenate([np.empty(0, dtype=H.U64), *(h[2] for h in hashes)]))
        self.stride = max([STRIDE, *(len(h[2]) for h in hashes)])
        found = [np.unique(np.searchsorted(self.terms, h[2]), return_counts=True) for h in hashes]
        n, mean = len(items), max(1.0, sum(len(h[2]) for h in hashes) / max(1, len(items)))
        df = np.bincount(np.concatenate([np.empty(0, dtype=np.int64), *(t for t, _ in found)]), minlength=len(self.terms))
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        weights = [idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(h[2]) / mean)) for (t, tf), h in zip(found, hashes, strict=True)]
        shingled = [[(self._shingles(h), min(words, len(h))) for h in x] for x in hashes]
        least = np.array([self._least(t, w, h, s, share, overlap) for (t, _), w, h, s in zip(found, weights, hashes, shingled, strict=True)])
        order = np.argsort(least, kind="stable").tolist()
        self.threshold = least[order]
        self.ids = np.array([items[i][0] for i in order], dtype=np.int64)
        self.parts = [[s for s, _ in shingled[i]] for i in order]
        #: Words in the shingles of each of these, fewer than usual where a part has fewer.
        self.sizes = [[k for _, k in shingled[i]] for i in order]
        lists: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        rare: list[tuple[int, int, float]] = []
        self.room = np.zeros(n)  # what the essential terms have to score
        for item, i in enumerate(order):
            for t, w in zip(found[i][0].tolist(), weights[i].tolist(), strict=True):
                lists[t].append((item, w))
            by_weight = np.argsort(-weights[i], kind="stable")
            rest = weights[i].sum() - np.cumsum(weights[i][by_weight])
            some = int(np.argmax(rest <= self.threshold[item] / 2)) + 1 if len(rest) else 0
            rare += [(int(found[i][0][k]), item, float(weights[i][k])) for k in by_weight[:some]]
            self.room[item] = (self.threshold[item] - rest[some - 1]) * (1 - 1e-9) if some else np.inf
        rare.sort()
        self.rare_first = np.searchsorted([t for t, _, _ in rare], np.arange(len(self.terms) + 1))
        self.rare_item, self.rare_weight = np.array([i for _, i, _ in rare], dtype=np.int64), np.array([w for _, _, w in rare])
        self.lists = [([i for i, _ in p], [w for _, w in p], [max(w for _, w in p[k : k + BLOCK]) for k in range(0, len(p), BLOCK)], max((w for _, w in p), default=0.0)) for p in lists]
        self.at_least = self.threshold.tolist()

    def _least(self, terms: np.ndarray, weights: np.ndarray, hashes: list[np.ndarray], shingled: list, share: float, overlap: float) -> float:
        """An item's threshold; infinite for one without words."""
        out = np.inf
        for k in (0, 2):
            if len(hashes[k]):
                part, size = shingled[k]
                distinct, first = np.unique(hashes[k], return_index=True)
                at = np.zeros(len(hashes[k]))  # a term's weight where it stands first
                at[first] = weights[np.searchsorted(terms, np.searchsorted(self.terms, distinct))]
                lacking = len(part) - math.ceil(overlap * len(part) - 1e-9)
                if len(at) > LONGEST:
                    missing = np.sort(at)[::-1][: 2 * lacking].sum()
                elif len(part) == len(at) - size + 1:
                    missing = _heaviest(at.tolist(), lacking, size)
                else:  # shingles that repeat: terms left of one that is there lack the one that starts with them, others the one that ends so
                    missing = np.sort(at[first])[::-1][: 2 * lacking].sum()
                out = min(out, max(at[first].min(), min(share * at.sum(), at.sum() - missing)) * (1 - 1e-9))
        return out

    @staticmethod
    def _words(text: bytes) -> np.ndarray:
        return H.words([text], lower=True)[3]

    def _shingles(self, h: np.ndarray) -> np.ndarray:
        """Distinct shingles; the whole where it has fewer words."""
        return np.unique(H.shingles(h, min(self.words, len(h)))) if len(h) else np.empty(0, dtype=H.U64)

    def _entering(self, chunk: np.ndarray, term: np.ndarray, of: np.ndarray) -> np.ndarray:
        """The passages (a chunk and the next one of its text) whose essential terms leave room for an item.

        chunk, term: known words; of: the text of each chunk.
        """
        use = np.flatnonzero(self.rare_first[term + 1] > self.rare_first[term])
        chunk, term = chunk[use], term[use]
        early = np.flatnonzero((chunk > 0) & (of[chunk] == of[chunk - 1]))
        pair = np.unique(np.concatenate([chunk, chunk[early] - 1]) * len(self.terms) + np.concatenate([term, term[early]]))
        passage, term = pair // len(self.terms), pair % len(self.terms)
        count = self.rare_first[term + 1] - self.rare_first[term]
        at = np.repeat(self.rare_first[term] - np.cumsum(count) + count, count) + np.arange(count.sum())
        pair = np.repeat(passage, count) * len(self.ids) + self.rare_item[at]
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        begin = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.empty(0, dtype=np.int64)
        if not len(begin):
            return begin
        sums = np.add.reduceat(self.rare_weight[at][order], begin)
        return np.unique(pair[begin[sums >= self.room[pair[begin] % len(self.ids)]]] // len(self.ids))

    def wand(self, terms: list[int]) -> list[tuple[int, float]]:
        """(item, score) of every item whose score under the distinct terms reaches its threshold."""
        out, need = [], self.at_least
        cursors = [[self.lists[t][0][0], 0, *self.lists[t]] for t in terms]  # item, position, items, weights, block maxima, maximum
        self.seen["postings"] += sum(len(c[2]) for c in cursors)
        while cursors:
            cursors.sort(key=lambda c: c[0])
            total, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                total += c[5]
                if total >= need[c[0]]:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            bound, last = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else len(need)
            for c in cursors[: pivot + 1]:
                p = bisect.bisect_left(c[2], item, c[1])
                if p < len(c[2]):
                    bound += c[4][p // BLOCK]
                    last = min(last, c[2][min(len(c[2]), (p // BLOCK + 1) * BLOCK) - 1] + 1)
            if bound >= need[item]:
                score, last = 0.0, item + 1
                for c in cursors[: pivot + 1]:
                    p = bisect.bisect_left(c[2], item, c[1])
                    if p < len(c[2]) and c[2][p] == item:
                        score += c[3][p]
                        self.seen["scored"] += 1
                if score >= need[item]:
                    out.append((item, score))
            last = max(last, item + 1)
            for c in cursors[: pivot + 1]:
                c[1] = bisect.bisect_left(c[2], last, c[1])
                c[0] = c[2][c[1]] if c[1] < len(c[2]) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return out

    def search(self, texts: list[bytes]) -> list[tuple[int, int, float, float, float, float]]:
        """(text, item, score, overlap of question, of answer, of both) for all that is retrieved."""
        best: dict[tuple[int, int], float] = {}
        if not len(self.terms):
            return []
        texts = [plain(t) for t in texts]
        for a, b in H.blocks(texts):
            _, _, _, h, first = H.words(texts[a:b], lower=True)
            if not len(h):
                continue
            term = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
            known = np.flatnonzero(self.terms[term] == h)
            sizes = np.diff(first)
            chunks = -(-sizes // self.stride)
            start = np.cumsum(chunks) - chunks
            doc = np.repeat(np.arange(b - a), sizes)[known]
            chunk, term = start[doc] + (known - first[doc]) // self.stride, term[known]
            of = np.repeat(np.arange(b - a), chunks)
            self.seen["passages"] += len(of)
            for c in self._entering(chunk, term, of).tolist():
                self.seen["entering"] += 1
                lo, hi = np.searchsorted(chunk, [c, c + 2 if c + 1 < len(of) and of[c + 1] == of[c] else c + 1])
                for item, score in self.wand(np.unique(term[lo:hi]).tolist()):
                    best[a + int(of[c]), item] = max(score, best.get((a + int(of[c]), item), 0.0))
        full: dict[tuple[int, int], np.ndarray] = {}
        checked = []
        for (text, item), score in sorted(best.items()):
            shares = []
            for part, n in zip(self.parts[item], self.sizes[item], strict=True):
                if (text, n) not in full:
                    if full and next(iter(full))[0] != text:
                        full.clear()
                    full[text, n] = self._all(texts[text], n)
                shares.append(float(np.isin(part, full[text, n]).mean()) if len(part) else 1.0)
            checked.append((text, item, score, *shares))
        return checked

    @staticmethod
    def _all(text: bytes, n: int) -> np.ndarray:
        h = H.words([text], lower=True)[3]
        return np.unique(H.shingles(h, n)) if n else np.empty(0, dtype=H.U64)


def split_item(text: str | None, least: int = 10) -> tuple[str, str]:
    """Question and answer of an item that has both in one text: the last sentence is the answer,
    if at least ``least`` words come before it; else all is question."""
    text = (text or "").strip()
    ends = [i + 1 for i, c in enumerate(text[:-1]) if c == "\n" or c in ".!?" and text[i + 1].isspace()]
    if ends and len(text[: ends[-1]].split()) >= least:
        return text[: ends[-1]].strip(), text[ends[-1] :].strip()
    return text, ""


def indexes(items: DataFrame, most: int = MAX_ITEMS, share: float = 0.75, *, overlap: float = 0.8) -> Iterator[Index]:
    """Indexes of at most about ``most`` items each (dealt by a hash of the id).

    items: (item_id, text) or (item_id, question, answer).  Items without words retrieve nothing.
    """
    turns = max(1, math.ceil(items.count() / most))
    for turn in range(turns):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(turns)) == turn).orderBy("item_id")
        if "question" in items.columns:
            rows = [(r["item_id"], r["question"] or "", r["answer"] or "") for r in part.select("item_id", "question", "answer").collect()]
        else:
            rows = [(r["item_id"], *split_item(r["text"])) for r in part.select("item_id", "text").collect()]
        yield Index(rows, share, overlap=overlap)


def leaks(docs: DataFrame, items: DataFrame, overlap: float = 0.8, text_col: str = "text") -> DataFrame:
    """The columns of docs with ``leaks``: for each item found in a document item_id, BM25 score and the
    overlaps of question, answer and both.

    An item is found if ``overlap`` of its shingles, or of its question's, occur in the text (letters
    A-Z in lower case, punctuation left out) and a passage of the text reaches its threshold.  Any passage
    that holds these shingles within the item's length does; shingles that are scattered over a long text,
    so that no passage is like the item, are no leak.  Null and empty texts hold nothing; no row is dropped.
    """
    row = StructType([StructField("item_id", LongType()), *(StructField(c, DoubleType()) for c in ("bm25", "question_overlap", "answer_overlap", "overlap"))])
    names = docs.drop("leaks").columns
    out = docs.drop("leaks").toDF(*(f"c{i}" for i in range(len(names))))
    at, added = names.index(text_col), []
    for index in indexes(items, overlap=overlap):

        def scan(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            kind = pa.list_(pa.struct([("item_id", pa.int64()), *((c, pa.float64()) for c in ("bm25", "question_overlap", "answer_overlap", "overlap"))]))
            for batch in batches:
                found: list[list] = [[] for _ in range(batch.num_rows)]
                for i in range(0, batch.num_rows, 1000):
                    for text, item, score, q, a, both in index.search(texts_of(batch.column(at).slice(i, 1000))):
                        if both >= overlap or q >= overlap:
                            found[i + text].append({"item_id": int(index.ids[item]), "bm25": score, "question_overlap": q, "answer_overlap": a, "overlap": both})
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, f"leaks{len(added)}"])

        out = out.mapInArrow(scan, StructType([*out.schema.fields, StructField(f"leaks{len(added)}", ArrayType(row))]))
        added.append(f"leaks{len(added)}")
    joined = F.flatten(F.array(*added)).alias("leaks")
    return out.select(*(F.col(f"c{i}") for i in range(len(names))), joined).toDF(*names, "leaks")


def op9_decontamination(spark, sf_dir) -> DataFrame:
    """Every pair of a document and a benchmark item found in it."""
    docs = by_column(spark, sf_dir, "documents").select("doc_id", "text")
    found = leaks(docs, by_column(spark, sf_dir, "benchmark")).select("doc_id", F.explode("leaks").alias("l"))
    return found.select("doc_id", "l.item_id", F.round("l.bm25", 6).alias("bm25"), "l.question_overlap", "l.answer_overlap", "l.overlap")
