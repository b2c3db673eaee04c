"""Best-fit packing planned on the histogram of piece lengths.

Lengths are at most ``capacity``, so the histogram has at most that many rows whatever the corpus
holds. Best-fit decreasing runs over its counts: all open sequences with the same room are treated as one
interval. The plan is a list of runs, "pieces of length L with ranks a to b go to sequences from s on,
k to each, at offset o". Each time an interval is used its room at least halves, so
the plan has at most about 11 x 3 x capacity runs (68,000 for 2,048). Pieces then take their planned slots by their rank
within their length.

Edge cases: NULL text is empty; an empty text is the end id alone. A document longer than the capacity is
cut from the end into full pieces, its first piece may be shorter. Repeated rows and ids are packed each on
its own. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.byte_bpe import byte_bpe
from ledgerline.llm.numbering import numbered
from ledgerline.llm.stages import arrow, materialize

END = (0).to_bytes(4, "little")
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2_048, ids: bool = False) -> DataFrame:
    """Pieces of every document: number, ids before it, length, checksum (and the ids)."""

    def run(batch: pa.RecordBatch) -> pa.Table:
        encoder, rows = byte_bpe(tokenizer), []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data = encoder.encode(text or "") + END
            n = len(data) // 4
            first = n - (-(-n // capacity) - 1) * capacity
            starts = [0, *range(first, n, capacity)]
            for k, (a, b) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                part = data[4 * a : 4 * b]
                rows.append((doc, k, a, b - a, zlib.crc32(part), *([part] if ids else [])))
        names = [c.split(" ")[0] for c in schema.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], names=names)

    schema = PIECES + (", ids binary" if ids else "")
    return arrow(docs.select("doc_id", "text"), run, schema)


@dataclass(frozen=True)
class Plan:
    """Runs, ordered by (length, first rank)."""

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    sequences: int

    def slots(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces given by length and rank."""
        at = np.searchsorted(self.length * (1 << 44) + self.rank, length.astype(np.int64) * (1 << 44) + rank, "right") - 1
        nth = rank - self.rank[at]
        return self.sequence[at] + nth // self.each[at], self.offset[at] + nth % self.each[at] * length


def plan_best_fit(histogram: Mapping[int, int], capacity: int) -> Plan:
    """Best-fit decreasing over counts. ``rooms[r]``: intervals of sequences with room ``r`` left."""
    rooms: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []  # rooms in use, ascending
    runs, opened = [], 0

    def add(room: int, first: int, count: int) -> None:
        if room and count:
            if room not in rooms:
                bisect.insort(order, room)
                rooms[room] = []
            rooms[room].append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(order, length)
            if at < len(order):
                room = order[at]
                first, count = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    order.pop(at)
            else:
                # open as many sequences as the rest needs
                room, first = capacity, opened
                count = -(-left // (capacity // length))
                opened += count
            each = room // length
            full = min(count, left // each)
            if full:
                runs.append((length, rank, first, each, capacity - room))
                rank, left = rank + full * each, left - full * each
                add(room - each * length, first, full)
            if full < count:
                if 0 < left < each:
                    runs.append((length, rank, first + full, each, capacity - room))
                    add(room - left * length, first + full, 1)
                    full, left = full + 1, 0
                add(room, first + full, count - full)
    columns = [np.array(c, np.int64) for c in zip(*sorted(runs), strict=True)] or [np.zeros(0, np.int64)] * 5
    return Plan(*columns, sequences=opened)


def pack_pieces(spark: SparkSession, pieces: DataFrame, capacity: int = 2_048) -> DataFrame:
    """Adds ``sequence_id`` and ``offset``. ``pieces`` is a stored table with doc_id, piece, length."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = spark.sparkContext.broadcast(plan_best_fit(histogram, capacity))

    @F.pandas_udf("sequence_id long, offset long")
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = plan.value.slots(length.to_numpy(np.int64), rank.to_numpy(np.int64))
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    ranked = numbered(pieces, "length", [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], "_rank")
    return ranked.withColumn("_slot", slot(F.col("length"), F.col("_rank"))).select(*pieces.columns, "_slot.*")


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer: str, capacity: int = 2_048) -> DataFrame:
    pieces = materialize(token_pieces(docs, tokenizer, capacity), "pieces")
    return pack_pieces(spark, pieces, capacity)
