"""Exact quantiles and bin counts of many columns at once, without a long table.

KLL sketches, merged by Spark, bracket every wanted rank of a column; columns go in blocks, so the sketches of a task have a
bounded size. One pass over the wide rows then counts what lies between the brackets and lists only the
values inside them, and the ranks are read off these. Tasks send counters and bracket values, never a row per cell.

NULL and NaN are left out. A rank outside its bracket (the bracket is over three times the sketch's error at 99 %)
fails the query instead of giving a wrong quantile.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.literals import double_array, quoted
from ledgerline.session import materialize

SKETCH = 8_192
BLOCK = 40
# rank error of a sketch of this size, at 99 %, times more than three
MARGIN = 2.5e-3
# (low, high) intervals per column, disjoint and rising
Brackets = list[list[tuple[float, float]]]


def brackets(df: DataFrame, columns: Sequence[str], probs: Sequence[float], sketch: int = SKETCH, margin: float = MARGIN) -> tuple[list[int], Brackets]:
    """Present values per column, and intervals that hold the wanted ranks."""
    around = [(max(p - margin, 0.0), min(p + margin, 1.0)) for p in probs]
    wanted = sorted({q for pair in around for q in pair})
    counts: list[int] = []
    out: Brackets = []
    for start in range(0, len(columns), BLOCK):
        block = columns[start : start + BLOCK]
        aggs = []
        for i, c in enumerate(block):
            v = f"nanvl(CAST({quoted(c)} AS DOUBLE), CAST(NULL AS DOUBLE))"
            aggs += [F.expr(f"count({v})").alias(f"n{i}"), F.expr(f"kll_sketch_agg_double({v}, {sketch})").alias(f"s{i}")]
        row = df.agg(*aggs).select(*[f"n{i}" for i in range(len(block))], *[
            F.when(F.col(f"n{i}") > 0, F.call_function("kll_sketch_get_quantile_double", F.col(f"s{i}"), double_array(wanted))).alias(f"q{i}")
            for i in range(len(block))]).first()
        for i in range(len(block)):
            counts.append(row[f"n{i}"])
            at = dict(zip(wanted, row[f"q{i}"] or [], strict=False))
            # the outermost ranks reach beyond the sketch's ends
            spans = [(-math.inf if a <= 0 else at[a], math.inf if b >= 1 else at[b]) for a, b in around] if row[f"n{i}"] else []
            out.append(_disjoint(spans))
    return counts, out


def _disjoint(spans: Sequence[tuple[float, float]]) -> list[tuple[float, float]]:
    out: list[tuple[float, float]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(quoted(c)).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])


def _present(batch: pa.RecordBatch, i: int) -> np.ndarray:
    v = batch.column(i).to_numpy(zero_copy_only=False)
    return v[~np.isnan(v)] + 0.0  # minus zero is zero


def bracket_cells(df: DataFrame, columns: Sequence[str], spans: Brackets) -> DataFrame:
    """column, part, value, n: values inside interval k (part 2k + 1) with their counts, and counts of the gap before it (part 2k)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gaps = [np.zeros(len(s) + 1, np.int64) for s in spans]
        ends = [(np.array([a for a, _ in s]), np.array([b for _, b in s])) for s in spans]
        names = ["column", "part", "value", "n"]
        for batch in batches:
            for i, (lows, highs) in enumerate(ends):
                v = _present(batch, i)
                if not len(lows) or not len(v):
                    continue
                below = np.searchsorted(highs, v, "left")  # intervals that end before the value
                inside = (below < len(highs)) & (v >= lows[np.minimum(below, len(lows) - 1)])
                gaps[i] += np.bincount(below[~inside], minlength=len(lows) + 1)
                if inside.any():
                    held, n = np.unique(v[inside], return_counts=True)
                    part = 2 * np.searchsorted(highs, held, "left") + 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(held), i, np.int32)), pa.array(part.astype(np.int32)), pa.array(held), pa.array(n.astype(np.int64))], names)
        column = np.repeat(np.arange(len(gaps)), [len(g) for g in gaps]).astype(np.int32)
        part = np.concatenate([2 * np.arange(len(g)) for g in gaps]).astype(np.int32)
        n = np.concatenate(gaps)
        yield pa.RecordBatch.from_arrays([pa.array(column), pa.array(part), pa.nulls(len(n), pa.float64()), pa.array(n)], names)

    cells = _columns(df, columns).mapInArrow(run, "column int, part int, value double, n long")
    return cells.where("n > 0").groupBy("column", "part", "value").agg(F.sum("n").alias("n"))


def exact_column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], sketch: int = SKETCH, margin: float = MARGIN) -> list[list[float]]:
    """Linear-interpolation quantiles of every column (empty for a column without values). ``df`` is read twice."""
    counts, spans = brackets(df, columns, probs, sketch, margin)
    cells = bracket_cells(df, columns, spans)
    over = Window.partitionBy("column", "part")
    upto = F.sum("n").over(over.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cells = cells.withColumn("upto", upto).withColumn("total", F.sum("n").over(over))
    cells = materialize(cells, "bracket_cells")
    totals: dict[int, dict[int, int]] = {}
    for r in cells.groupBy("column", "part").agg(F.max("total").alias("total")).collect():  # a few rows per column
        totals.setdefault(r["column"], {})[r["part"]] = r["total"]
    asked = []
    for i, n in enumerate(counts):
        for k in sorted({r for p in probs for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))}) if n else []:
            before = 0
            for part in sorted(totals[i]):
                if k < before + totals[i][part]:
                    break
                before += totals[i][part]
            if part % 2 == 0:
                raise ValueError(f"rank {k} of {columns[i]} lies outside its bracket")
            asked.append((i, part, k, k - before))
    if not asked:
        return [[] for _ in columns]
    ranks = df.sparkSession.createDataFrame(asked, "column int, part int, rank long, place long")
    found = cells.join(F.broadcast(ranks), ["column", "part"]).where("place >= upto - n AND place < upto")  # twice the probabilities per column
    value = {(r["column"], r["rank"]): r["value"] for r in found.select("column", "rank", "value").collect()}
    return [[_between(value, i, n, p) for p in probs] if n else [] for i, n in enumerate(counts)]


def _between(value: Mapping[tuple[int, int], float], i: int, n: int, p: float) -> float:
    at = p * (n - 1)
    low, high, t = value[i, math.floor(at)], value[i, math.ceil(at)], at - math.floor(at)
    if low == high:
        return low
    return low + (high - low) * t if t < 0.5 else high - (high - low) * (1 - t)


def bin_counts(df: DataFrame, columns: Sequence[str], edges: Sequence[Sequence[float]]) -> DataFrame:
    """column, bin, n: values by the number of inner edges at or below them."""
    bins = max((len(e) for e in edges), default=0) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(edges), bins), np.int64)
        for batch in batches:
            for i, e in enumerate(edges):
                if len(e):
                    held[i] += np.bincount(np.searchsorted(np.array(e), _present(batch, i), "right"), minlength=bins)
        column, bin_ = np.nonzero(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(column.astype(np.int32)), pa.array(bin_.astype(np.int32)), pa.array(held[column, bin_])], ["column", "bin", "n"])

    cells = _columns(df, columns).mapInArrow(run, "column int, bin int, n long")
    return cells.groupBy("column", "bin").agg(F.sum("n").alias("n"))
