"""Best-fit packing of texts into training sequences of several permitted lengths.

Texts longer than the longest sequence are cut into pieces first.  Pieces are dealt to shards of about
``SHARD`` pieces, however few documents or ids they come from; in each, pieces are placed from the longest to the shortest into the open sequence they fill best.
When none has room, a sequence is opened in the length that costs least: its length, plus a fixed cost a
sequence, per token it can be expected to hold given what is still to be placed.  At the end every
sequence is downsized to the shortest length that holds its contents.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.store import cut, word_count

LENGTHS = (256, 512, 1024, 2048)
#: Cost of a sequence besides its length, pieces in a shard, and seed of the dealing.
OVERHEAD, SHARD, SEED = 8, 20_000, 41


def pack(sizes: np.ndarray, lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence of each piece, where it begins there, and each sequence's final length.  Sizes are
    between 0 and the longest length."""
    lengths = tuple(sorted(lengths))
    order = np.argsort(-sizes, kind="stable")
    where, begin = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    filled: list[int] = []
    room: list[int] = []  # distinct free space of open sequences, in order
    open_at: dict[int, list[int]] = {}
    left = int(sizes.sum())
    waiting = list(sizes[order])

    def free(space: int, sequence: int) -> None:
        if space not in open_at:
            bisect.insort(room, space)
            open_at[space] = []
        open_at[space].append(sequence)

    def cheapest(size: int, rest: int, shortest: int) -> int:
        """The length with the least cost per token: it fills up only from what is still waiting, and
        leaves on average half the shortest waiting piece empty."""
        best, length = float("inf"), lengths[-1]
        for option in lengths:
            if option >= size:
                slack = option - size
                used = size + (min(rest, max(0, slack - shortest / 2)) if slack >= shortest else 0)
                cost = (option + overhead) / max(used, 1)
                if cost < best:
                    best, length = cost, option
        return length

    shortest = int(sizes.min()) if len(sizes) else 0
    for i, size in zip(order, waiting, strict=True):
        size = int(size)
        left -= size
        if not size and filled:  # takes no room
            where[i], begin[i] = len(filled) - 1, filled[-1]
            continue
        at = bisect.bisect_left(room, size)
        if at < len(room):
            space = room[at]
            sequence = open_at[space].pop()
            if not open_at[space]:
                del open_at[space], room[at]
        else:
            sequence, space = len(filled), cheapest(size, left, max(shortest, 1))
            filled.append(0)
        where[i], begin[i] = sequence, filled[sequence]
        filled[sequence] += size
        if space > size:
            free(space - size, sequence)
    contents = np.array(filled, np.int64)
    final = np.asarray(lengths)[np.searchsorted(lengths, contents)] if len(contents) else contents
    return where, begin, final


_PLACED = "shard int, sequence long, capacity int, begin int, doc_id {id}, piece int, first_word long, n_words int"


def pack_documents(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """One row per piece: shard and sequence (which name a sequence together), its final capacity in
    words, where the piece begins in it, and the piece: doc_id, number, first word, words.

    Every word of every row is in exactly one piece.  Null and word-less texts are one piece of no words.
    Repeated rows are packed as often as they come, numbered apart, so they spread over the shards too; so
    do rows of a null id.  Pieces of one size keep the order of id and number.
    An empty table gives no rows.  Other columns are not read.
    """
    longest = max(lengths)
    sized = docs.select(F.col(id_col).alias("doc_id"), word_count(F.col(text_col).cast("string")).alias("n"))
    pieces = sized.select("doc_id", "n", F.posexplode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(longest).cast("long"))).alias("piece", "first_word"))
    pieces = pieces.select("doc_id", "piece", "first_word", F.least(F.col("n") - F.col("first_word"), F.lit(longest)).cast("int").alias("n_words"))
    alike = cut(pieces.groupBy(*pieces.columns).count())
    shards = max(1, -(-(alike.agg(F.sum("count")).first()[0] or 0) // shard))
    each = alike.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count")))).drop("count")
    dealt = each.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "n_words", "again", F.lit(SEED)), F.lit(shards)).cast("int")).drop("again")

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "piece", "n_words"], kind="stable")
        where, begin, final = pack(group["n_words"].to_numpy(np.int64), lengths)
        out = group.assign(sequence=where, capacity=final[where].astype(np.int32), begin=begin.astype(np.int32))
        return out[["shard", "sequence", "capacity", "begin", "doc_id", "piece", "first_word", "n_words"]]

    return dealt.groupBy("shard").applyInPandas(place, _PLACED.format(id=pieces.schema["doc_id"].dataType.simpleString()))
