"""Hard-negative mining (operator 12) by product quantisation with stored residual norms.

Vectors of integers are cut into subspaces of WIDTH components; each part is coded by the nearest of
CENTROIDS integer points.  A vector's approximation differs from it by a residual whose norm is stored,
so an inner product with an anchor lies within |anchor| * |residual| of the one with the approximation,
which is a sum of entries of the anchor's lookup table.  Pairs whose interval cannot matter are left out
for certain; of the others the exact integer inner product is computed.

Blocks of rows meet groups of anchors, each pair of them in one call: first for the best rows of an
anchor's own label (its positives), then, with the positives' scores as windows, for the best rows of
other labels within each window.  A call returns no more than the wanted ranks of each anchor or window.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.samples import least_hashed
from quarry.llm.common import by_column, discard, materialize

#: Vectors that the centroids are fitted on: a bound.  They decide about speed, not results.
SAMPLE = 4096
#: Components of a subspace, its centroids, and the steps that fit them.
WIDTH, CENTROIDS, STEPS = 2, 256, 6
#: Rows of a block and anchors of a group at most, rows of a block at least, and blocks that keep a small cluster busy.
BLOCK, GROUP, LEAST, BLOCKS = 16_384, 4_096, 256, 24
#: Anchors whose tables are held at once, and pairs whose vectors are.
TABLES, PAIRS = 128, 1 << 16
_PACKED = "dim long, part long, ids binary, labels binary, x binary, codes binary, residuals binary"


def _parts(x: np.ndarray) -> np.ndarray:
    """Rows cut into subspaces, the last filled with zeros: (subspaces, rows, WIDTH)."""
    x = np.pad(x, ((0, 0), (0, -x.shape[1] % WIDTH)))
    return x.reshape(len(x), -1, WIDTH).transpose(1, 0, 2)


def fit(sample: np.ndarray) -> np.ndarray:
    """Integer centroids (subspaces, centroids, WIDTH) by k-means from evenly spaced rows in order."""
    out = []
    for part in _parts(sample.astype(np.float64)):
        points = np.unique(part, axis=0)
        centres = points[np.linspace(0, len(points) - 1, min(CENTROIDS, len(points))).astype(int)]
        for _ in range(STEPS):
            near = _nearest(part, centres)
            count = np.bincount(near, minlength=len(centres))[:, None]
            sums = np.stack([np.bincount(near, weights=c, minlength=len(centres)) for c in part.T], axis=1)
            centres = np.where(count > 0, sums / np.maximum(count, 1), centres)
        out.append(np.pad(np.rint(centres).astype(np.int64), ((0, CENTROIDS - len(centres)), (0, 0)), mode="edge"))
    return np.stack(out)


def _nearest(part: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(part), dtype=np.int64)
    for i in range(0, len(part), 4096):
        out[i : i + 4096] = ((centres * centres).sum(1) - 2.0 * part[i : i + 4096] @ centres.T).argmin(1)
    return out


def encode(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows, subspaces) and residual norms, rounded up."""
    parts = _parts(x)
    codes = np.stack([_nearest(p.astype(np.float64), c.astype(np.float64)) for p, c in zip(parts, centroids, strict=True)], axis=1)
    rest = np.zeros(len(x))
    for s, p in enumerate(parts):
        gap = (p - centroids[s][codes[:, s]]).astype(np.float64)
        rest += (gap * gap).sum(1)
    return codes.astype(np.uint8), np.sqrt(rest) * (1 + 1e-9)


def intervals(anchors: np.ndarray, centroids: np.ndarray, codes: np.ndarray, residuals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each row with each anchor (rows, anchors)."""
    whole = _parts(anchors)
    most = float(np.abs(anchors).max(initial=0)) * float(np.abs(centroids).max(initial=0)) * anchors.shape[1]
    kind = np.int32 if most < 1 << 29 and float(residuals.max(initial=0)) * np.abs(anchors).max(initial=0) * math.sqrt(anchors.shape[1]) < 1 << 29 else np.int64
    score = np.zeros((len(codes), len(anchors)), dtype=kind)
    for s, c in enumerate(centroids):
        score += (c @ whole[s].T).astype(kind)[codes[:, s]]
    norms = np.sqrt((anchors.astype(np.float64) ** 2).sum(1)) * (1 + 1e-9)
    reach = np.ceil(np.outer(residuals, norms)).astype(kind)
    return score - reach, score + reach


def exact(x: np.ndarray, anchors: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer inner products of rows i with anchors j."""
    out = np.empty(len(i), dtype=np.int64)
    for a in range(0, len(i), PAIRS):
        out[a : a + PAIRS] = np.einsum("ij,ij->i", x[i[a : a + PAIRS]].astype(np.int64), anchors[j[a : a + PAIRS]].astype(np.int64))
    return out


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest of each column; the least there is where a column has fewer."""
    return np.partition(values, len(values) - k, axis=0)[len(values) - k] if len(values) >= k else np.full(values.shape[1], np.iinfo(values.dtype).min, dtype=values.dtype)


def _first(keys: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first k of each key: higher scores first, ties by smaller id."""
    order = np.lexsort((ids, -scores, keys))
    ranked = keys[order]
    begin = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    rank = np.arange(len(ranked)) - np.repeat(begin, np.diff(np.append(begin, len(ranked))))
    return order[rank < k]


class Packed:
    """A block of rows or a group of anchors, as packed()'s columns hold it."""

    def __init__(self, row: dict, kind: str):
        self.ids, self.labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
        n = len(self.ids)
        self.x = np.frombuffer(row["x"], kind).reshape(n, -1)
        self.codes = np.frombuffer(row["codes"], np.uint8).reshape(n, -1)
        self.residuals = np.frombuffer(row["residuals"], "<f8")


def best_of_label(rows: Packed, anchors: Packed, centroids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(anchor, positive, score): the first k other rows of each anchor's label."""
    found = [], [], []
    for label in np.intersect1d(rows.labels, anchors.labels).tolist():
        some, wanted = np.flatnonzero(rows.labels == label), np.flatnonzero(anchors.labels == label)
        for at in range(0, len(wanted), TABLES):
            own = wanted[at : at + TABLES]
            low, high = intervals(anchors.x[own], centroids, rows.codes[some], rows.residuals[some])
            itself = rows.ids[some][:, None] == anchors.ids[own]
            low[itself] = np.iinfo(low.dtype).min
            i, j = np.nonzero((high >= _kth(low, k)) & ~itself)
            score = exact(rows.x, anchors.x, some[i], own[j])
            best = _first(j, score, rows.ids[some[i]], k)
            for out, values in zip(found, (own[j[best]], rows.ids[some[i[best]]], score[best]), strict=True):
                out.append(values)
    return tuple(np.concatenate([np.empty(0, np.int64), *f]) for f in found)


def bounds_of(scores: np.ndarray, percent: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest integers between low and high hundredths of each score."""
    return -((-percent[0] * scores) // 100), (percent[1] * scores) // 100


def best_in_windows(rows: Packed, anchors: Packed, centroids: np.ndarray, k: int, windows: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """(window, negative, score): the first k rows of other labels than the anchor's in each window.

    windows: each one's anchor, in ascending order, and least and greatest score.
    """
    owner, least, most = windows
    found = [], [], []
    for at in range(0, len(anchors.ids), TABLES):
        begin, end = np.searchsorted(owner, [at, at + TABLES])
        if begin == end:
            continue
        own = np.arange(at, min(at + TABLES, len(anchors.ids)))
        low, high = intervals(anchors.x[own], centroids, rows.codes, rows.residuals)
        other = rows.labels[:, None] != anchors.labels[own]
        lowest = np.iinfo(low.dtype).min
        turn = np.arange(begin, end) - np.searchsorted(owner, owner[begin:end])  # which of its anchor's windows
        for t in range(int(turn.max()) + 1):
            w = begin + np.flatnonzero(turn == t)
            a = owner[w] - at
            lo, hi = (np.clip(v[w], lowest, np.iinfo(low.dtype).max) for v in (least, most))
            below, above = low[:, a], high[:, a]
            maybe = (above >= lo) & (below <= hi) & other[:, a]
            sure = maybe & (below >= lo) & (above <= hi)
            i, j = np.nonzero(maybe & (above >= _kth(np.where(sure, below, lowest), k)))
            score = exact(rows.x, anchors.x, i, own[a[j]])
            inside = (score >= least[w[j]]) & (score <= most[w[j]])
            i, j, score = i[inside], j[inside], score[inside]
            best = _first(j, score, rows.ids[i], k)
            for out, values in zip(found, (w[j[best]], rows.ids[i[best]], score[best]), strict=True):
                out.append(values)
    return tuple(np.concatenate([np.empty(0, np.int64), *f]) for f in found)


def packed(rows: DataFrame, parts: int, centroids: np.ndarray, kind: str) -> DataFrame:
    """Distinct rows (dim, id, label, v) of one length, drawn by hash into numbered parts, one row for each."""

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        values = np.asarray(table["v"].combine_chunks().flatten(), dtype=np.int64)
        x = values.reshape(table.num_rows, -1)
        codes, residuals = encode(x, centroids)
        flat = [np.asarray(table[c], dtype="<i8").tobytes() for c in ("id", "label")] + [x.astype(kind).tobytes(), codes.tobytes(), residuals.astype("<f8").tobytes()]
        row = [pa.array([x.shape[1]], pa.int64()), pa.array([key[0].as_py()], pa.int64()), *(pa.array([b], pa.binary()) for b in flat)]
        return pa.Table.from_arrays(row, names=["dim", "part", "ids", "labels", "x", "codes", "residuals"])

    drawn = rows.withColumn("part", F.pmod(F.xxhash64("id", "label", "v"), F.lit(parts)))
    return drawn.repartition(parts, "part").groupBy("part").applyInArrow(pack, _PACKED)


def _meet(blocks: DataFrame, n_blocks: int, groups: DataFrame, n_groups: int, call: Callable, schema: str) -> DataFrame:
    """call(block, group) for every pair, each in a group of its own: both sides go once to each partner."""
    keys = ["block", "group"]
    one = blocks.withColumnRenamed("part", "block").withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    two = groups.withColumnRenamed("part", "group").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    n = min(n_blocks * n_groups, 20_000)
    one, two = (df.withColumns({c: F.col(c).cast("int") for c in keys}).repartition(n, *keys) for df in (one, two))

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [f.split()[0] for f in schema.split(", ")]
        if not left.num_rows or not right.num_rows:  # a part that the hash left empty
            return pa.Table.from_arrays([pa.array([], pa.int64()) for _ in names], names=names)
        found = call(left.to_pylist()[0], right.to_pylist()[0])
        return pa.Table.from_arrays([pa.array(np.broadcast_to(c, np.shape(found[-1])), pa.int64()) for c in found], names=names)

    return one.groupBy(*keys).cogroup(two.groupBy(*keys)).applyInArrow(both, schema)


def _mined(rows: DataFrame, wanted: DataFrame, dim: int, size: int, most: int, positives: int, negatives: int, percent: tuple[int, int]) -> DataFrame:
    """The result for the rows of one length; ``most``: the greatest component."""
    sample = least_hashed(rows, ["id", "v"], SAMPLE, size).select("v").collect()
    centroids = fit(np.array([r["v"] for r in sample], dtype=np.int64))
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    n_blocks = -(-size // min(BLOCK, max(LEAST, -(-size // BLOCKS))))
    blocks = materialize(packed(rows, n_blocks, centroids, kind), "blocks")
    n_groups = max(1, -(-wanted.count() // GROUP))
    groups = materialize(packed(wanted, n_groups, centroids, kind), "groups")

    def same(block: dict, group: dict) -> tuple:
        anchors = Packed(group, kind)
        j, ids, score = best_of_label(Packed(block, kind), anchors, centroids, positives)
        return group["group"], j, anchors.ids[j], ids, score

    fields = "group long, anchor long, anchor_id long, positive_id long, score long"
    each = Window.partitionBy("group", "anchor").orderBy(F.desc("score"), "positive_id")
    first = _meet(blocks, n_blocks, groups, n_groups, same, fields).withColumn("n", F.row_number().over(each)).where(F.col("n") <= positives)
    first = materialize(first, "positives")
    of_group = first.groupBy(F.col("group").alias("part")).agg(F.array_sort(F.collect_list(F.struct("anchor", "n", "anchor_id", "positive_id", "score"))).alias("windows"))  # positives of GROUP anchors

    def other(block: dict, group: dict) -> tuple:
        own = np.array([[w["anchor"], w["anchor_id"], w["positive_id"], w["score"], w["n"]] for w in group["windows"]], dtype=np.int64).reshape(-1, 5).T
        w, ids, score = best_in_windows(Packed(block, kind), Packed(group, kind), centroids, negatives, (own[0], *bounds_of(own[3], percent)))
        return group["group"], own[0][w], own[4][w], own[1][w], own[2][w], own[3][w], ids, score

    fields = "group long, anchor long, n long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    each = Window.partitionBy("group", "anchor", "n").orderBy(F.desc("negative_score"), "negative_id")
    met = _meet(blocks, n_blocks, groups.join(of_group, "part"), n_groups, other, fields)
    found = materialize(met.withColumn("rank", F.row_number().over(each)).where(F.col("rank") <= negatives), "negatives")
    discard(blocks, groups, first)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def mine(vectors: DataFrame, anchors: str = "vec_id % 50 = 0", positives: int = 5, negatives: int = 3, percent: tuple[int, int] = (50, 95), scale: float = 256.0, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become floor(scale * x).  Anchors are the rows for which ``anchors`` (over the id column)
    holds; an anchor's positives are its first ``positives`` other rows of the same label; the first
    ``negatives`` rows of other labels whose score lies between ``percent`` hundredths of a positive's are
    its negatives.  Higher scores come first, ties by smaller id.

    Rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part.
    Rows that are equal in id, label and integers count once; others that share an id are rows of their
    own, which may be each other's negatives but not positives.  Vectors of different lengths do not meet.  Components beyond
    isqrt(2^62 / length), which no long could hold a score of, count as that.
    """
    column = lambda c: F.col(f"`{c}`")
    rows = vectors.select(column(id_col).cast("long").alias(id_col), column(label_col).cast("long").alias("label"), column(vector_col).cast("array<double>").alias("x"))
    fine = "label is not null and x is not null and size(x) > 0 and forall(x, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))"
    limit = "cast(floor(sqrt(4611686018427387904 / size(x))) as bigint)"
    integers = F.expr(f"transform(x, c -> greatest(-{limit}, least({limit}, cast(floor({scale!r}D * c) as bigint))))")
    kept = rows.where(column(id_col).isNotNull()).where(fine).select(column(id_col).alias("id"), "label", integers.alias("v"), F.expr(anchors).alias("wanted")).distinct()
    kept = materialize(kept, "vectors")
    greatest = F.max(F.expr("array_max(transform(v, c -> abs(c)))")).alias("most")
    lengths = kept.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), greatest, F.count_if("wanted").alias("anchors")).where("anchors > 0").orderBy("dim").collect()
    out = []
    for r in lengths:
        own = kept.where(F.size("v") == r["dim"])
        out.append(_mined(own.select("id", "label", "v"), own.where("wanted").select("id", "label", "v"), r["dim"], r["n"], r["most"], positives, negatives, percent))
    if not out:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    discard(kept)
    all_ = out[0]
    for more in out[1:]:
        all_ = all_.unionByName(more)
    return all_


def op12_negatives(spark, sf_dir) -> DataFrame:
    """Hard negatives of every 50th vector among all; every 7th vector has the label after its own."""
    rows = by_column(spark, sf_dir, "embeddings")
    return mine(rows.withColumn("label", F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end")))


ORACLE_SQL = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [floor(256 * x::double) for x in embedding] as e from embeddings
  where label is not null and embedding is not null and len(embedding) > 0 and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, list_dot_product(a.e, b.e)::bigint as score from v a, v b where a.vec_id % 50 = 0),
p as (select * from s where same and other_id <> anchor_id qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5),
n as (select p.anchor_id, p.other_id as positive_id, s.other_id as negative_id, p.score as positive_score, s.score as negative_score,
  row_number() over (partition by p.anchor_id, p.other_id order by s.score desc, s.other_id) as rank
  from p join s on s.anchor_id = p.anchor_id and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 3
"""
