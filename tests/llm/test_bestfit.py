"""Best-fit packing: a round trip over all pieces, and the rounds against a plain loop."""

from __future__ import annotations

import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import bestfit, common, packing

DOCS = [(1, "a short text"), (2, None), (3, ""), (4, "word " * 9_000), (5, " \n\t "), (6, "one"), (6, "one"), (6, "another"), (None, "no id"), (7, "x" * 30_000), (8, "é ü 😀 <|endoftext|>")]


def checked(packed, length):
    """Sequences of a packing, each filled from 0 without a gap and no longer than ``length``."""
    bins = defaultdict(list)
    for r in packed:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for rows in bins.values():
        at = 0
        for offset, size in sorted(rows):
            assert offset == at
            at += size
        assert at <= length
    return bins


def ids_of(text, tokenizer):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("which", ["data", "awkward"])
def test_round_trip(spark, data, which):
    from tokenizers import Tokenizer

    rows = DOCS if which == "awkward" else [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"length": F.lit(1), "a.b": F.lit(2), "bin": F.lit(3), "piece_id": F.lit(4)})
    got = bestfit.pack_documents(df, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    want = sorted((i is None, i or 0, ids_of(t, tokenizer)) for i, t in rows)
    texts = defaultdict(list)
    for r in got:
        assert r["start"] == 2048 * r["piece"] and r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())
        texts[r["doc_id"]].append((r["piece"], list(r["ids"])))
    whole = []
    for i, cut in texts.items():
        firsts = [ids for p, ids in cut if p == 0]
        if len(firsts) > 1:
            whole += [(i is None, i or 0, ids) for ids in firsts]  # repeated ids: these texts are short
        else:
            whole.append((i is None, i or 0, [x for _, ids in sorted(cut) for x in ids]))
    assert sorted(whole) == want
    tokens = sum(len(w) for _, _, w in want)
    bins = checked(got, 2048)
    assert len(bins) <= math.ceil(tokens / 2048) + 1


def items(spark, sizes):
    rows = [(i, int(s)) for i, s in enumerate(sizes)]
    return common.materialize(spark.createDataFrame(rows, "piece_id long, length long"), "pieces")


@pytest.mark.parametrize("seed, low, high, group, carry", [(1, 1, 60, 50, 20), (2, 40, 100, 40, 10), (3, 51, 99, 30, 3), (4, 1, 101, 64, 500), (5, 34, 34, 25, 8)])
def test_rounds_lose_and_cut_nothing(spark, seed, low, high, group, carry):
    sizes = np.random.default_rng(seed).integers(low, high + 1, 900).clip(1, 100)
    got = bestfit.pack_best_fit(items(spark, sizes), 100, group, 3, carry, 0).collect()
    assert sorted((r["piece_id"], r["length"]) for r in got) == [(i, s) for i, s in enumerate(sizes.tolist())]
    bins = checked(got, 100)
    one = len(set(bestfit.best_fit_decreasing(sizes, 100)[0].tolist()))
    alone = bestfit.pack_best_fit(items(spark, sizes), 100, group, 3, 0, 0).select("sequence_id").distinct().count()
    assert len(bins) <= alone  # without rounds that merge
    assert len(bins) <= 1.05 * one + 3  # one group of all; groups as small as these have less to choose from


def test_merging_rounds_fill_what_groups_leave(spark):
    """Groups of one size leave a bin of it each; those are packed together in the rounds above."""
    sizes = [30] * 400
    got = bestfit.pack_best_fit(items(spark, sizes), 100, 10, 4, 50, 8).collect()
    assert len(checked(got, 100)) <= 134 + 4  # 133.3 is the least


def test_best_fit_decreasing_equals_a_plain_loop():
    for seed in range(20):
        rng = np.random.default_rng(seed)
        sizes = rng.integers(1, 50, 200)
        bins, offsets = bestfit.best_fit_decreasing(sizes, 50)
        free, want = [], []
        for s in sorted(sizes.tolist(), reverse=True):
            fits = [f for f in free if f >= s]
            if fits:
                free.remove(min(fits))
                free.append(min(fits) - s)
            else:
                free.append(50 - s)
        fill = np.bincount(bins, weights=sizes)
        assert sorted(50 - f for f in free) == sorted(fill.astype(int).tolist())
        for b in range(len(fill)):
            own = np.flatnonzero(bins == b)
            own = own[np.argsort(offsets[own])]
            assert (offsets[own] == np.cumsum(sizes[own]) - sizes[own]).all()


def test_nothing_to_pack(spark):
    assert bestfit.pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_only_full_pieces(spark):
    got = bestfit.pack_best_fit(items(spark, [100] * 5), 100).collect()
    assert len({r["sequence_id"] for r in got}) == 5 and all(r["offset"] == 0 for r in got)
