"""Contiguous shards whose largest size is as small as it can be.

Atomic groups stand in the order of a 64-bit key. The smallest capacity that a given number
of contiguous shards needs is found by binary search with a greedy check. The driver never sees the groups:
it holds the sizes of key ranges, at first 2**16 of equal width, and asks Spark to
split only those ranges in which the search had to cut. Once every cut it looks at falls between single groups,
the answer is exact.

Edge cases: NULL text counts 0 bytes and is one group with the empty text. Equal texts (equal 64-bit hashes)
share a shard. A group above the mean size gets a shard to itself as far as
the order allows. Fewer groups than shards leave shards empty; an empty table gives no rows. Repeated ids are
numbered each on its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.numbering import numbered
from ledgerline.llm.stages import materialize, text_bytes

TOP_BITS = 16
STEP_BITS = 12


@dataclass
class Ranges:
    """Key ranges in order: first key (unsigned), size, groups; ``ends`` are running sizes."""

    first: np.ndarray
    bits: np.ndarray
    size: np.ndarray
    groups: np.ndarray

    def __post_init__(self) -> None:
        self.ends = np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)
        self.asked: set[int] = set()

    def last_within(self, limit: int) -> int:
        """Largest cut whose running size is at most ``limit``."""
        at = int(np.searchsorted(self.ends, limit, "right")) - 1
        # the range after the cut may hold a later cut, if it has several groups
        if at < len(self.size) and self.ends[at] < limit and self.groups[at] > 1 and self.bits[at] > 0:
            self.asked.add(at)
        return at

    def first_from(self, limit: int) -> int:
        """Smallest cut whose running size is at least ``limit``."""
        at = int(np.searchsorted(self.ends, limit, "left"))
        if at > 0 and self.ends[at] > limit and self.groups[at - 1] > 1 and self.bits[at - 1] > 0:
            self.asked.add(at - 1)
        return at


def shards_needed(ranges: Ranges, capacity: int, most: int) -> int:
    """Greedy check: shards of ``capacity`` that hold everything, ``most + 1`` if more."""
    at, n, end = 0, 0, len(ranges.size)
    while at < end and n <= most:
        reached = ranges.last_within(int(ranges.ends[at]) + capacity)
        if reached == at:
            return most + 1
        at, n = reached, n + 1
    return n if at >= end else most + 1


def smallest_capacity(ranges: Ranges, shards: int) -> int:
    total = int(ranges.ends[-1])
    low = -(-total // shards)
    high = max(low, int(ranges.size.max(initial=0)) + low)
    while low < high:
        middle = (low + high) // 2
        if shards_needed(ranges, middle, shards) <= shards:
            high = middle
        else:
            low = middle + 1
    return low


def even_cuts(ranges: Ranges, shards: int, capacity: int) -> list[int]:
    """Cuts under ``capacity``, each as near as it can be to an even share of what is left."""
    total, end = int(ranges.ends[-1]), len(ranges.size)
    # latest[j]: the earliest cut from which shards j, j + 1, ... can hold the rest
    latest = [end]
    for _ in range(shards - 1):
        latest.append(ranges.first_from(int(ranges.ends[latest[-1]]) - capacity))
    latest.reverse()
    cuts, at = [], 0
    for j in range(shards - 1):
        here = int(ranges.ends[at])
        goal = here + (total - here) / (shards - j)
        below = ranges.last_within(int(goal))
        above = ranges.first_from(int(np.ceil(goal)))
        near = above if ranges.ends[above] - goal < goal - ranges.ends[below] else below
        most = ranges.last_within(here + capacity)
        at = max(at, min(max(near, latest[j]), most))
        cuts.append(at)
    return cuts


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """First key (unsigned) of every shard after the first, and the capacity found.

    ``groups``: a stored table with ``key`` (BIGINT, ordered as unsigned) and ``size``, one row
    per atomic group. A cut at 2**64 means that the shards after it are empty.
    """
    spark = groups.sparkSession
    unit = F.struct(F.sum("size").alias("size"), F.count(F.lit(1)).alias("groups"))
    rest = 64 - TOP_BITS
    top = groups.groupBy(F.shiftrightunsigned("key", rest).alias("cell")).agg(unit.alias("u"))
    found = [(r["cell"] << rest, rest, r["u"]["size"], r["u"]["groups"]) for r in top.collect()]  # at most 2**16
    while True:
        found.sort()
        columns = list(zip(*found, strict=True)) or [(), (), (), ()]
        ranges = Ranges(np.array(columns[0], np.uint64), *[np.array(c, np.int64) for c in columns[1:]])
        capacity = smallest_capacity(ranges, shards)
        cuts = even_cuts(ranges, shards, capacity)
        if not ranges.asked:
            break
        asked = [found[i] for i in ranges.asked]
        keep = [x for i, x in enumerate(found) if i not in ranges.asked]
        # signed form of the unsigned first key; few thousand rows, bounded by shards and bits
        split = spark.createDataFrame(
            [(_signed(f) >> b, b, max(0, b - STEP_BITS)) for f, b, _, _ in asked], "cell long, bits int, finer int")
        parts = []
        for bits in sorted({b for _, b, _, _ in asked}):
            here = F.broadcast(split.where(F.col("bits") == bits).select("cell", "finer"))
            cell = groups.withColumn("cell", F.shiftright("key", bits)).join(here, "cell")
            fine = F.expr("shiftright(key, finer)").alias("fine")
            parts += cell.groupBy(fine, "finer").agg(unit.alias("u")).collect()
        found = keep + [
            ((r["fine"] << r["finer"]) % (1 << 64), r["finer"], r["u"]["size"], r["u"]["groups"]) for r in parts]
    keys = [int(ranges.first[c]) if c < len(ranges.first) else 1 << 64 for c in cuts]
    return keys, capacity


def _signed(key: int) -> int:
    return key - (1 << 64) if key >= 1 << 63 else key


def shard_documents(docs: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """Shard and gapless slot of every document; equal texts stay together.

    Returns doc_id, size, text_crc32, shard, slot. The order key is a hash of the text, so the cuts
    alone place a document: neither texts nor rows are moved until slots are numbered.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", (text_bytes() + overhead).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
    )
    rows = materialize(rows, "shard_rows")
    groups = materialize(rows.groupBy("key").agg(F.sum("size").alias("size")), "shard_groups")
    keys, _ = minimax_cuts(groups, shards)
    placed = rows.withColumn("shard", _shard_of(F.col("key"), keys))
    placed = materialize(placed, "shard_placed")
    return numbered(placed, "shard", [F.col("key"), F.col("doc_id")], "slot").drop("key")


def _shard_of(key, cuts: list[int]):
    """Number of cuts at or below the key; flipping the top bit turns unsigned order into signed."""
    flipped = key.bitwiseXOR(F.lit(-(1 << 63)))
    shard = F.lit(0)
    for cut in cuts:
        if cut < 1 << 64:
            shard = shard + (flipped >= F.lit(cut - (1 << 63))).cast("int")
    return shard
