"""Best-fit packing (operator 11): hierarchical residual packing.

Pieces of documents are packed by best-fit decreasing in groups drawn by hash.  Bins that are nearly
full are final.  Those that are not go up as items of the group's parent, FANOUT groups to one, where
they are packed by best fit again; a bin of the parent holds whole bins of its children one after the
other.  So it goes up to one root.  What a group hands up is bounded: its emptiest bins, of which room
for others can be expected; the fuller ones stay as they are, so no group grows with the input.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import by_column, materialize
from quarry.llm.packing import pieces, vocabulary_path

#: Pieces of a group of the first round, groups merged into one, and bins a group hands up at most.
GROUP, FANOUT, CARRY = 4000, 8, 500
#: Tokens that may be free in a bin that counts as nearly full.
SLACK = 8
#: Ids of bins: the round, the group in it, the bin in the group.
_ROUND, _GROUP = 1 << 58, 1 << 32
_FULL = 1 << 62


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item: longest first (ties by position), into the bin that it leaves least room in.

    Open bins lie in stacks by their free space; the bits of one number tell which stacks hold any.
    """
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_, made = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        if above := open_ >> need:
            free = need + (above & -above).bit_length() - 1
            b = stacks[free].pop()
            if not stacks[free]:
                open_ ^= 1 << free
        else:
            free, b, made = capacity, made, made + 1
        bins[i], offsets[i] = b, capacity - free
        if left := free - need:
            stacks[left].append(b)
            open_ |= 1 << left
    return bins, offsets


def _round(items: DataFrame, level: int, capacity: int, last: bool, slack: int, carry: int) -> DataFrame:
    """Items (item, size, group) with bin, offset, fill of the bin, and up: whether it is handed on."""

    def place(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["size", "item"], ascending=[False, True], kind="stable")
        bins, offsets = best_fit_decreasing(part["size"].to_numpy(), capacity)
        fill = np.bincount(bins, weights=part["size"].to_numpy()).astype(np.int64)
        up = np.zeros(len(fill), dtype=bool)
        if not last:
            emptiest = np.argsort(fill, kind="stable")[:carry]
            up[emptiest] = fill[emptiest] < capacity - slack
        group = int(part["group"].iloc[0])
        return pd.DataFrame({"item": part["item"], "bin": level * _ROUND + group * _GROUP + bins, "offset": offsets, "fill": fill[bins], "up": up[bins], "group": group})

    return items.groupBy("group").applyInPandas(place, "item long, bin long, offset long, fill long, up boolean, group long")


def pack_best_fit(cut: DataFrame, length: int = 2048, group: int = GROUP, fanout: int = FANOUT, carry: int = CARRY, slack: int = SLACK) -> DataFrame:
    """Adds sequence_id and offset to pieces, a written table with a ``piece_id`` of each and its ``length``.

    A piece that fills a sequence is one, without a shuffle.  Only ids and sizes of the others are shuffled,
    in the first round; later rounds read the handed-up bins of the round before.
    """
    rest = cut.where(F.col("length") < length)
    groups = max(1, round(rest.count() / group))
    items = rest.select(F.col("piece_id").alias("item"), F.col("length").alias("size"), F.pmod(F.xxhash64("piece_id"), F.lit(groups)).alias("group"))
    rounds = [materialize(_round(items, 0, length, groups == 1, slack, carry), "round")]
    while groups > 1:
        groups = -(-groups // fanout)
        items = rounds[-1].where("up and offset = 0").select(F.col("bin").alias("item"), F.col("fill").alias("size"), F.expr(f"`group` div {fanout}").alias("group"))
        rounds.append(materialize(_round(items, len(rounds), length, groups == 1, slack, carry), "round"))
    placed = None  # of the items of the round above: sequence and offset there
    for table in reversed(rounds):
        stays = table.where("not up").select("item", F.col("bin").alias("sequence_id"), "offset")
        if placed is not None:
            above = placed.select(F.col("item").alias("bin"), "sequence_id", F.col("offset").alias("_before"))
            goes = table.where("up").select("item", "bin", "offset").join(above, "bin")
            stays = stays.unionByName(goes.select("item", "sequence_id", (F.col("offset") + F.col("_before")).alias("offset")))
        placed = stays
    whole = cut.where(F.col("length") >= length).select("*", (F.col("piece_id") + _FULL).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return rest.join(placed.withColumnRenamed("item", "piece_id"), "piece_id").unionByName(whole)


def pack_documents(docs: DataFrame, vocabulary: str | None = None, length: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and place: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset, and the ids themselves (with_ids).

    Null and empty texts have the end token alone; repeated ids are separate documents.  Only documents
    longer than a sequence are cut, at multiples of ``length``.
    """
    made = pieces(docs, vocabulary or vocabulary_path(), end_id, length, id_col, text_col, with_ids).drop("document", "doc_tokens")
    cut = materialize(made.withColumn("piece_id", F.monotonically_increasing_id()), "pieces")
    packed = pack_best_fit(cut, length).withColumn("piece", F.expr(f"cast(start div {length} as int)"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))


def op11_bestfit(spark, sf_dir) -> DataFrame:
    """All documents in as few sequences of 2048 tokens as the rounds find."""
    return pack_documents(by_column(spark, sf_dir, "documents"))
