"""Sharding by best-fit-decreasing bin packing.

Documents with equal texts are a group that stays together. Groups enter bins of one capacity in order of falling size;
each enters the bin with the least remaining room that still holds it, found in a balanced tree of remaining rooms. A
new bin is opened only when none fits, which keeps the number of bins low.

Groups of one size can be exchanged, and the tightest bin stays the tightest while it fills. So the packing needs only
the number of groups of each size: sizes are rounded up to 13 significant bits (at most 1 part in 4096), which leaves at
most 4096 classes for each power of two however many documents there are. The classes are packed on the driver; a class
is one run of group ranks for each bin it enters. Spark numbers the groups of a class (by cells, so that a frequent size
is no single task) and looks their bins up in the runs.

A group that alone is larger than a bin can't stay whole: it's cut into pieces that just fit, by distributed ranks.

Results for odd inputs: a null text counts as an empty one; sizes are at least 1, so empty documents spread by the same
law; equal rows are members of one group; no rows give no rows. Extra columns stay as they are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from workmart.llm.common import cells_for, store, with_rank

SIGNIFICANT = 13


class RoomTree:
    """A treap of (room, bin): the bin with the least room of at least some size, in logarithmic time."""

    def __init__(self):
        self.root, self.state = None, 88172645463325252

    def _random(self) -> int:  # xorshift: the same tree at every run
        x = self.state
        x ^= (x << 13) & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 7
        x ^= (x << 17) & 0xFFFFFFFFFFFFFFFF
        self.state = x
        return x

    def _split(self, node, key):
        """Nodes below `key`, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            return (node[0], node[1], node[2], low), high
        low, high = self._split(node[2], key)
        return low, (node[0], node[1], high, node[3])

    def _join(self, low, high):
        if low is None or high is None:
            return low or high
        if low[1] > high[1]:
            return (low[0], low[1], low[2], self._join(low[3], high))
        return (high[0], high[1], self._join(low, high[2]), high[3])

    def add(self, room: int, bin_: int) -> None:
        low, high = self._split(self.root, (room, bin_))
        self.root = self._join(self._join(low, ((room, bin_), self._random(), None, None)), high)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return (room, bin) with the least room >= size; of equal rooms the first bin."""
        low, high = self._split(self.root, (size, -1))
        if high is None:
            return None
        node = high
        while node[2] is not None:
            node = node[2]
        _, rest = self._split(high, (node[0][0], node[0][1] + 1))
        self.root = self._join(low, rest)
        return node[0]


def pack(sizes: list[int], counts: list[int], capacity: int, most_bins: int | None = None) -> list[tuple[int, int, int]] | None:
    """Runs (size, rank of the first group after the run, bin), sizes falling. None if more than `most_bins` would be opened."""
    tree, runs, bins = RoomTree(), [], 0
    for size, count in zip(sizes, counts):
        if size > capacity:
            raise ValueError(f"a group of {size} is larger than a bin of {capacity}")
        done = 0
        while done < count:
            found = tree.take_tightest(size)
            if found is None:
                if bins == most_bins:
                    return None
                found, bins = (capacity, bins), bins + 1
            room, bin_ = found
            n = min(count - done, room // size)  # it stays the tightest until the next one doesn't fit
            done += n
            runs.append((size, done, bin_))
            tree.add(room - n * size, bin_)
    return runs


def least_capacity(sizes: list[int], counts: list[int], bins: int) -> tuple[int, list[tuple[int, int, int]]]:
    """The least capacity, to 1 part in 20,000, at which best-fit-decreasing needs no more than `bins`; and the packing."""
    total = sum(s * c for s, c in zip(sizes, counts))
    if not total:
        return 1, []
    low = max(-(-total // bins), max(sizes))
    if (runs := pack(sizes, counts, low, bins)) is not None:
        return low, runs
    step = max(1, low // 20_000)
    reach = step
    while (runs := pack(sizes, counts, low + reach, bins)) is None:
        reach *= 2
    high, best, below = low + reach, runs, low + reach // 2
    while high - below > step:
        middle = (high + below) // 2
        if (runs := pack(sizes, counts, middle, bins)) is None:
            below = middle
        else:
            high, best = middle, runs
    return high, best


def rounded(size: Column) -> Column:
    """Up to 13 significant bits."""
    unit = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.floor(F.log2(size.cast("double"))) + 1 - SIGNIFICANT)).cast("long")
    return (F.ceil(size / unit) * unit).cast("long")


def shard(df: DataFrame, id: str = "doc_id", text: str = "text", shards: int | None = None, capacity: int | None = None) -> DataFrame:
    """The columns of `df` but its text, with size, text_crc32, shard and slot (gapless in each shard).

    Give `shards` for a fixed number of bins of the least common capacity, or `capacity` (bytes) for the fewest bins.
    """
    if (shards is None) == (capacity is None):
        raise ValueError("give shards or capacity")
    own = ("size", "text_crc32", "shard", "slot")
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    names = [c for c in df.columns if c not in own]
    slim = df.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names) if c != text], (F.octet_length(whole) + 1).cast("long").alias("size"),
                     F.crc32(whole.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(whole, 256)).alias("_group"),
                     F.col(f"`{id}`").alias("_id"), F.monotonically_increasing_id().alias("_row"))
    slim = store(slim)
    groups = slim.groupBy("_group").agg(F.count(F.lit(1)).alias("_copies"), F.max("size").alias("_size"))
    groups = store(groups)
    rows = slim.count()
    total = groups.agg(F.sum(F.col("_copies") * F.col("_size"))).first()[0] or 0
    room = max(1, capacity if capacity else -(-total // shards))
    # pieces of groups that are larger than a bin; there are at most total / room such groups
    per_piece = F.greatest(F.lit(1), F.floor(F.lit(room) / F.col("_size"))).cast("long")
    large = F.col("_copies") * F.col("_size") > room
    pieces = groups.withColumn("_each", F.when(large, per_piece).otherwise(F.col("_copies")))
    last = F.ceil(F.col("_copies") / F.col("_each")).cast("long") - 1
    pieces = pieces.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    pieces = pieces.withColumn("_bytes", F.least(F.col("_each"), F.col("_copies") - F.col("_piece") * F.col("_each")) * F.col("_size")).withColumn("_class", rounded(F.col("_bytes")))
    ranked = store(with_rank(pieces.select("_group", "_piece", "_each", "_copies", "_class"), ["_class"], ["_group", "_piece"], cells_for(rows), "_rank"))
    classes = sorted(((r["_class"], r["count"]) for r in ranked.groupBy("_class").count().collect()), reverse=True)
    sizes, counts = [c[0] for c in classes], [c[1] for c in classes]
    if shards:
        runs = least_capacity(sizes, counts, shards)[1]
    else:
        runs = pack(sizes, counts, max([rounded_int(capacity), *sizes]))
    placed = _with_bins(ranked, runs)
    # members of cut groups find their piece by their rank in the group; for all others the piece is 0
    cut = F.broadcast(groups.filter(large).select("_group")) if total // room < 10_000 else groups.filter(large).select("_group")
    inside = with_rank(slim.join(cut, "_group", "left_semi"), ["_group"], ["_id", "_row"], cells_for(rows), "_at")
    members = slim.join(cut, "_group", "left_anti").withColumn("_at", F.lit(0).cast("long")).unionByName(inside)
    where = placed.select("_group", "_piece", "_each", "shard")
    whole_groups = where.filter(F.col("_piece") == 0).select("_group", "_each", F.col("shard").alias("_first"))
    rest = where.filter(F.col("_piece") > 0).select("_group", "_piece", "shard")
    found = members.join(whole_groups, "_group").withColumn("_piece", F.floor(F.col("_at") / F.col("_each")))
    found = found.join(rest, ["_group", "_piece"], "left").withColumn("shard", F.coalesce("shard", "_first")).drop("_first", "_each", "_piece", "_at")
    slots = with_rank(store(found), ["shard"], ["_group", "_id", "_row"], cells_for(rows), "slot")
    return slots.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names) if c != text], *own)


def rounded_int(size: int) -> int:
    unit = 1 << max(0, size.bit_length() - SIGNIFICANT)
    return size // unit * unit


def _with_bins(ranked: DataFrame, runs: list[tuple[int, int, int]]) -> DataFrame:
    """The bin of each ranked group: the first run of its class that ends after its rank. There are no more runs than classes and bins together."""
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 3)
    starts = np.unique(table[:, 0], return_index=True)

    def look_up(batches):
        for pdf in batches:
            at = starts[1][np.searchsorted(starts[0], pdf["_class"].to_numpy())] if len(pdf) else np.empty(0, dtype=np.int64)
            ranks, low = pdf["_rank"].to_numpy(), at.copy()
            ends = np.append(starts[1][1:], len(table))[np.searchsorted(starts[0], pdf["_class"].to_numpy())] if len(pdf) else at
            high = ends - 1
            while (low < high).any():  # all rows' binary searches at once
                middle = (low + high) // 2
                right = table[middle, 1] <= ranks
                low, high = np.where(right & (low < high), middle + 1, low), np.where(right | (low >= high), high, middle)
            yield pd.DataFrame({"_group": pdf["_group"], "_piece": pdf["_piece"], "_each": pdf["_each"], "shard": table[low, 2].astype("int32")})

    return ranked.select("_group", "_piece", "_each", "_class", "_rank").mapInPandas(look_up, "_group binary, _piece long, _each long, shard int")
