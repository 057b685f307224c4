"""Best-fit packing of token sequences into bins of several permitted lengths.

A bin of length c costs c + c * c / QUADRATIC + overhead: a long sequence is dearer per token, since attention grows with the
square, and every sequence has a fixed cost. Documents longer than the largest length are cut into pieces. Rows
are dealt into shards of bounded size, and each shard is packed by itself: pieces in falling order go into the
open bin that they fill best; if none has room, each permitted length is filled on trial from the histogram of the
lengths still to come, and the one with the least cost for each token it would hold is opened. At the end each bin
shrinks to the smallest permitted length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.tables import checkpointed

CAPACITIES = (512, 1024, 2048, 4096, 8192)
QUADRATIC = 16_384


class Remaining:
    """How many pieces of each length are still to come; they are taken in falling order."""

    def __init__(self, lengths: list[int]):
        counts = Counter(lengths)
        self.sizes = sorted(counts)
        self.counts = [counts[n] for n in self.sizes]

    def take_largest(self) -> None:
        self.counts[-1] -= 1
        if not self.counts[-1]:
            self.sizes.pop()
            self.counts.pop()

    def fill(self, room: int) -> int:
        """The part of ``room`` that the pieces would fill, the largest that fit first."""
        free, k = room, len(self.sizes)
        while free and (k := min(k, bisect_right(self.sizes, free))):
            k -= 1
            free -= self.sizes[k] * min(self.counts[k], free // self.sizes[k])
        return room - free


def opened_and_final(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = 16) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """For each piece its bin and offset; for each bin the length it was opened with, and its final length."""
    cost = {c: c + c * c / QUADRATIC + overhead for c in capacities}
    remaining = Remaining(lengths)
    places: list[tuple[int, int]] = [(-1, 0)] * len(lengths)
    used: list[int] = []
    size: list[int] = []
    rooms: list[int] = []  # distinct free spaces of open bins, ascending
    bins: dict[int, list[int]] = {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = lengths[i]
        remaining.take_largest()
        at = bisect_left(rooms, need)
        if at < len(rooms):
            room = rooms[at]
            b = bins[room].pop()
            if not bins[room]:
                del bins[room]
                rooms.pop(at)
        else:
            cap = min((c for c in capacities if c >= need), key=lambda c: (cost[c] / (need + remaining.fill(c - need)), c))
            b, room = len(used), cap
            used.append(0)
            size.append(cap)
        places[i] = b, used[b]
        used[b] += need
        if (room := size[b] - used[b]) > 0:
            if room not in bins:
                insort(rooms, room)
            bins.setdefault(room, []).append(b)
    return places, size, [min(c for c in capacities if c >= u) for u in used]


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = 16) -> tuple[list[tuple[int, int]], list[int]]:
    """For each piece its bin and offset, and for each bin its final length. Pieces fit the largest capacity."""
    places, _, final = opened_and_final(lengths, capacities, overhead)
    return places, final


def token_estimate(text: Column) -> Column:
    """About four characters to a token."""
    return F.ceil(F.length(text) / 4)


def pack_documents(
    docs: DataFrame, length: Column, id_col: str = "doc_id", capacities: tuple[int, ...] = CAPACITIES, shard_rows: int = 20_000
) -> DataFrame:
    """One row per piece: doc_id, piece, start, n_tokens, bin_id, bin_offset, capacity.

    ``length`` is a document's number of tokens. A document without any (null text too) has one row with
    n_tokens 0 and no bin. Every token of every document is in exactly one piece, and pieces of a bin do not
    overlap. Repeated rows are packed one by one; an empty table gives an empty result. Shards hold about
    ``shard_rows`` rows whatever the size of the table and whatever ids repeat or are null: the pieces are checkpointed
    and dealt by their places there.
    """
    top = max(capacities)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(length.cast("long"), F.lit(0)).alias("n_tokens"))
    cuts = F.greatest(F.ceil(F.col("n_tokens") / top), F.lit(1)).cast("int")
    pieces = rows.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), cuts - 1)).alias("piece"))
    start = F.col("piece").cast("long") * top
    pieces = pieces.select("doc_id", "piece", start.alias("start"), F.least(F.col("n_tokens") - start, F.lit(top)).alias("n_tokens"))
    pieces = checkpointed(pieces)
    shards = max(1, -(-pieces.count() // shard_rows))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "n_tokens"], kind="stable").reset_index(drop=True)
        full = pdf["n_tokens"] > 0
        places, sizes = pack(pdf.loc[full, "n_tokens"].tolist(), capacities)
        base = int(pdf["shard"].iloc[0]) << 32 if len(pdf) else 0
        pdf["bin_id"] = pd.array([None] * len(pdf), dtype="Int64")
        pdf["bin_offset"], pdf["capacity"] = 0, 0
        pdf.loc[full, "bin_id"] = [base + b for b, _ in places]
        pdf.loc[full, "bin_offset"] = [o for _, o in places]
        pdf.loc[full, "capacity"] = [sizes[b] for b, _ in places]
        return pdf[["doc_id", "piece", "start", "n_tokens", "bin_id", "bin_offset", "capacity"]]

    schema = f"doc_id {id_type}, piece int, start long, n_tokens long, bin_id long, bin_offset long, capacity int"
    return dealt.groupBy("shard").applyInPandas(run, schema)
