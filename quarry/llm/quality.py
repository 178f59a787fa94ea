"""Quality classifier (operator 6): random indexing, pooling and a small calibrated network.

Random indexing: every word is hashed to one of BUCKETS rows; the row sums the sparse random index
vectors of the words next to it, over all documents.  A document is pooled to the mean of its words'
normalised context vectors, the mean of sparse random vectors of its words' endings, shapes and
repetitions, and a few norms.  A two-layer numpy network, trained on the driver on a bounded sample
of labelled documents, gives a logit; a temperature fitted on a part of that sample calibrates it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quarry.llm import wordhash as H
from quarry.llm.common import by_column, texts_of

BUCKETS, DIM, NONZERO = 4096, 64, 4
#: Documents of the labelled sample that the network is trained on: a bound, whatever the input.
MAX_TRAIN = 20_000
THRESHOLD = 0.3


def _index(h: np.ndarray, nonzero: int = NONZERO) -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of each hash's sparse random index vector."""
    shifts = np.arange(nonzero, dtype=np.uint64)
    positions = (h[:, None] >> (shifts * np.uint64(6))[None, :]) & np.uint64(DIM - 1)
    signs = (h[:, None] >> (shifts + np.uint64(40))[None, :]) & np.uint64(1)
    return positions.astype(np.int64), signs.astype(np.float64) * 2 - 1


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(50)).astype(np.int64) & (BUCKETS - 1)


def context_sums(docs: DataFrame) -> np.ndarray:
    """BUCKETS x DIM context vectors over all documents; the result's size does not depend on them."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(BUCKETS * DIM)
        for batch in batches:
            texts = texts_of(batch.column(0))
            for a, b in H.blocks(texts):
                _, _, _, h, first = H.words(texts[a:b])
                if len(h) < 2:
                    continue
                inside = np.ones(len(h) - 1, dtype=bool)  # pairs of neighbours in one document
                cuts = first[1:-1]
                inside[cuts[(cuts > 0) & (cuts < len(h))] - 1] = False
                rows, (positions, signs) = _bucket(h) * DIM, _index(h)
                left, right = np.flatnonzero(inside), np.flatnonzero(inside) + 1
                for own, other in ((left, right), (right, left)):
                    table += np.bincount((rows[own][:, None] + positions[other]).ravel(), signs[other].ravel(), BUCKETS * DIM)
        table = table.reshape(BUCKETS, DIM)
        used = np.flatnonzero(table.any(axis=1))
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array(table[used, k]) for k in range(DIM))], names=["bucket", *(f"v{k}" for k in range(DIM))])

    parts = docs.select("text").mapInArrow(gather, "bucket int, " + ", ".join(f"v{k} double" for k in range(DIM)))
    sums = parts.groupBy("bucket").agg(*(F.sum(f"v{k}").alias(f"v{k}") for k in range(DIM))).collect()
    out = np.zeros((BUCKETS, DIM))
    for row in sums:
        out[row[0]] = row[1:]
    return out


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Unit context vectors, of single precision."""
    return (sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)).astype(np.float32)


FEATURES = 2 * DIM + 8


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """FEATURES numbers for each text; an empty text has zeros."""
    out = np.zeros((len(texts), FEATURES))
    for a, b in H.blocks(texts):
        buf, starts, ends, h, first = H.words(texts[a:b])
        n = len(h)
        if not n:
            continue
        counts = np.diff(first)
        doc = np.repeat(np.arange(b - a), counts)
        size = np.maximum(counts, 1)[:, None]
        context = np.zeros((b - a, DIM))
        has = np.flatnonzero(counts)
        for i in range(0, len(has), 64):  # bounds the gathered vectors
            some = has[i : i + 64]
            lo, hi = first[some[0]], first[some[-1] + 1]
            context[some] = np.add.reduceat(vectors[_bucket(h[lo:hi])], first[some] - lo, axis=0)
        kinds = np.zeros((4, len(buf) + 1), dtype=np.int32)
        for k, (x, y) in enumerate(((65, 90), (97, 122), (48, 57))):
            np.cumsum((buf >= x) & (buf <= y), out=kinds[k, 1:])
        np.cumsum((buf > 32) & (buf < 128), out=kinds[3, 1:])
        upper, lower, digit, plain = (kinds[k][ends] - kinds[k][starts] for k in range(4))
        marks = plain - upper - lower - digit
        same = np.zeros(n, dtype=bool)
        same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        shape = np.minimum(upper, 2) + 3 * (lower > 0) + 6 * (digit > 0) + 12 * np.minimum(marks, 3) + 48 * same
        ending = H.hash_spans(buf, np.maximum(starts, ends - 3), ends)
        index = np.zeros((b - a) * DIM)
        for feature in (H.mix(shape.astype(np.uint64) + H.constant("shape")), ending):
            positions, signs = _index(feature, 2)
            index += np.bincount((doc[:, None] * DIM + positions).ravel(), signs.ravel(), (b - a) * DIM)
        index = index.reshape(b - a, DIM)
        mean = lambda x: np.bincount(doc, x, b - a)[:, None] / size  # noqa: E731, B023
        context, index = context / size, index / size
        part = [context, index, np.linalg.norm(context, axis=1, keepdims=True), np.linalg.norm(index, axis=1, keepdims=True), np.log1p(counts)[:, None], mean(ends - starts), mean(same), mean(upper), mean(marks), mean(digit)]
        out[a:b] = np.hstack(part)
    return out


class Network:
    """Two layers with tanh between, trained by Adam on cross-entropy; fixed seed."""

    def __init__(self, hidden: int = 32, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7):
        self.hidden, self.epochs, self.rate, self.decay, self.seed = hidden, epochs, rate, decay, seed
        self.temperature, self.prior = 1.0, 0.5
        self.weights: list[np.ndarray] = []

    def logits(self, x: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(x), np.log(self.prior / (1 - self.prior)))
        w1, b1, w2, b2 = self.weights
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2[0]

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        """Without rows of both classes the score is the (smoothed) share of ones."""
        self.prior = (y.sum() + 1) / (len(y) + 2)
        if len(set(y.tolist())) < 2:
            return self
        rng = np.random.default_rng(self.seed)
        order = rng.permutation(len(y))
        held, own = order[: len(y) // 6], order[len(y) // 6 :]
        self.mean, self.scale = x[own].mean(0), x[own].std(0) + 1e-6
        z = (x - self.mean) / self.scale
        w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], self.hidden)), np.zeros(self.hidden), rng.normal(0, 1 / np.sqrt(self.hidden), self.hidden), np.zeros(1)]
        m, v, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
        for _ in range(self.epochs):
            rng.shuffle(own)
            for i in range(0, len(own), 128):
                rows = own[i : i + 128]
                a = np.tanh(z[rows] @ w[0] + w[1])
                d = (1 / (1 + np.exp(-(a @ w[2] + w[3][0]))) - y[rows]) / len(rows)
                back = np.outer(d, w[2]) * (1 - a * a)
                step += 1
                for k, g in enumerate((z[rows].T @ back + self.decay * w[0], back.sum(0), a.T @ d + self.decay * w[2], np.array([d.sum()]))):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    w[k] = w[k] - self.rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.weights = w
        if len(held):
            t = np.linspace(0.5, 5, 91)
            out = self.logits(x[held])[None, :] / t[:, None]
            self.temperature = float(t[np.argmin(np.logaddexp(0, np.where(y[held] == 1, -out, out)).mean(1))])
        return self

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> tuple[Network, np.ndarray]:
    """Network and word vectors.

    labels: (doc_id, quality); rows with crc32 of doc_id modulo 5 = 0, of a null id or of a null
    quality are not used; of repeated ids the least quality counts.  The sample is the max_train
    rows that come first by a hash of doc_id.
    """
    vectors = word_vectors(context_sums(docs))
    own = labels.where("doc_id is not null and quality is not null").where(~held_out("doc_id"))
    own = own.groupBy("doc_id").agg(F.min("quality").cast("double").alias("quality"))
    sample = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                x = pooled(texts_of(part.column(1)), vectors).astype(np.float32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "quality", "x"])

    # the sample has at most max_train rows of two numbers: small enough to broadcast at any size
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "quality").mapInArrow(features, "doc_id long, quality double, x binary")
    rows = rows.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("x").alias("x")).orderBy("doc_id").collect()
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows], dtype=np.float64).reshape(len(rows), FEATURES)
    return Network().fit(x, np.array([r["quality"] for r in rows])), vectors


def held_out(column: str):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0


def score(docs: DataFrame, network: Network, vectors: np.ndarray) -> DataFrame:
    """The columns of docs with score: the probability of label 1, also for null and empty texts."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            parts = [network.scores(pooled(texts_of(batch.column(at).slice(i, 2000)), vectors)) for i in range(0, batch.num_rows, 2000)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=[*batch.schema.names, "score"])

    docs = docs.drop("score")
    names = docs.columns
    plain = docs.toDF(*(c if c == "text" else f"c{i}" for i, c in enumerate(names)))  # names may hold dots
    return plain.mapInArrow(apply, StructType([*plain.schema.fields, StructField("score", DoubleType())])).toDF(*names, "score")

def op6_quality(spark, sf_dir) -> DataFrame:
    """Every document's score; predicted is 1 from THRESHOLD."""
    docs = by_column(spark, sf_dir, "documents")
    scored = score(docs.select("doc_id", "text"), *fit(docs, by_column(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
