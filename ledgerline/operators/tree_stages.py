"""Scores of a tree ensemble after 1, 2, ... trees, from leaf columns.

The library finds each row's leaf in each tree (``leafCol``); the saved model's node table says what a leaf is worth. A score after
some trees is then a sum over the first leaves of a row, as a column expression. Choosing the number of trees counts rows
instead of sorting them: one pass fills a histogram per stage, whose cells bound the rank metric from below and
above, and only stages that the bounds leave open are ranked row by row.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.rank_metrics import metric_bounds_of, rank_metric
from ledgerline.session import materialize

BINS = 1_024
LEAVES = "leaves"
Bounds = Mapping[int, tuple[float, float]]


@dataclass(frozen=True)
class LeafValues:
    """What every leaf of every tree adds to the score, trees and leaves in the library's order.

    A boosted model adds margins, a forest averages the trees' shares of positives.
    """

    values: tuple[tuple[float, ...], ...]
    averaged: bool

    def score(self, leaves: Column, trees: int | Column) -> Column:
        """Margin or mean share after ``trees`` trees."""
        held = self.values[:trees] if isinstance(trees, int) else self.values
        table = F.from_json(F.lit(json.dumps(held)), "array<array<double>>")
        parts = F.zip_with(F.slice(leaves, 1, trees), F.slice(table, 1, trees), lambda at, v: F.element_at(v, at.cast("int") + 1))
        total = F.aggregate(parts, F.lit(0.0), lambda total, v: total + v)
        return total / trees if self.averaged else total

    def probability(self, leaves: Column, trees: int) -> Column:
        score = self.score(leaves, trees)
        return score if self.averaged else 1 / (1 + F.exp(-2 * score))


def read_leaf_values(spark: SparkSession, path: str, averaged: bool) -> LeafValues:
    """From the node table of a saved ensemble: as many rows as the model has leaves."""
    nodes = spark.read.parquet(f"{path}/data").where("nodeData.leftChild < 0")
    nodes = nodes.select("treeID", F.col("nodeData.id").alias("id"), F.col("nodeData.prediction").alias("margin"), F.col("nodeData.impurityStats").alias("counts"))
    worth = F.expr("counts[1] / aggregate(counts, 0D, (a, x) -> a + x)") if averaged else F.col("margin") * F.col("weight")
    weights = spark.read.parquet(f"{path}/treesMetadata").toDF("treeID", "_meta", "weight").drop("_meta")
    # leaves are numbered from left to right, as their node numbers are
    per_tree = nodes.join(weights, "treeID").groupBy("treeID").agg(F.array_sort(F.collect_list(F.struct("id", worth.alias("v")))).alias("l"))
    rows = per_tree.select("treeID", F.col("l.v").alias("v")).orderBy("treeID").collect()
    return LeafValues(tuple(tuple(r["v"]) for r in rows), averaged)


def with_leaves(model, df: DataFrame) -> DataFrame:
    """Adds ``leaves``: the row's leaf in every tree."""
    only = {model.getParam(p): "" for p in ("predictionCol", "rawPredictionCol", "probabilityCol")}
    found = model.copy({**only, model.leafCol: "_leaf"}).transform(df)
    return found.withColumn(LEAVES, vector_to_array("_leaf")).drop("_leaf")


def stage_counts(leafed: DataFrame, values: LeafValues, target: str, stages: Sequence[int], bins: int = BINS) -> DataFrame:
    """stage, bin, p, g: positives and negatives per cell of the score after each stage.

    A stage's cells have equal width between the smallest and the largest sum its leaves can make. Every task sends its
    counters, so rows never multiply.
    """
    widest = max(map(len, values.values))
    table = np.array([[*v, *[0.0] * (widest - len(v))] for v in values.values])
    low = np.cumsum([min(v) for v in values.values])
    span = np.cumsum([max(v) for v in values.values]) - low
    chosen = np.array(sorted(stages))
    shared = leafed.sparkSession.sparkContext.broadcast((table, low[chosen], np.where(span[chosen] > 0, span[chosen], 1.0), chosen))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, low, span, chosen = shared.value
        cells = np.zeros((len(chosen), bins, 2), np.int64)
        first = np.arange(len(chosen)) * bins
        for batch in batches:
            leaves = batch.column(0).flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, -1)
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for rows in range(0, len(y), 512):
                part = leaves[rows : rows + 512]
                sums = np.cumsum(table[np.arange(part.shape[1]), part], axis=1)[:, chosen]
                place = np.clip(((sums - low) / span * bins).astype(np.int64), 0, bins - 1) + first
                flat = (place * 2 + y[rows : rows + 512, None]).ravel()
                cells += np.bincount(flat, minlength=cells.size).reshape(cells.shape)
        at, bin_ = np.nonzero(cells.any(axis=2))
        held = cells[at, bin_]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (chosen[at].astype(np.int32), bin_.astype(np.int32), held[:, 1].copy(), held[:, 0].copy())], ["stage", "_bin", "p", "g"])

    sent = leafed.select(LEAVES, F.col(target).cast("int").alias(target)).mapInArrow(count, "stage int, _bin int, p long, g long")
    return sent.groupBy("stage", "_bin").agg(F.sum("p").alias("p"), F.sum("g").alias("g"))


def stage_scores(leafed: DataFrame, values: LeafValues, key: str, target: str, stages: Sequence[int]) -> DataFrame:
    """key, target, stage, score: every row after each of the chosen stages (0-based), as ``LeafValues.score`` gives it.

    The leaf values go to the tasks once; in a plan they would stand as text, as often as there are stages.
    """
    chosen = np.array(sorted(stages))
    last, trees = int(chosen[-1]) + 1, len(values.values)
    widest = max(map(len, values.values[:last]))
    table = np.array([[*v, *[0.0] * (widest - len(v))] for v in values.values[:last]])
    shared = leafed.sparkSession.sparkContext.broadcast((table, chosen, chosen + 1 if values.averaged else np.ones(len(chosen))))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, chosen, share = shared.value
        for batch in batches:
            leaves = batch.column(2).flatten().to_numpy().astype(np.int64).reshape(-1, trees)
            for at in range(0, batch.num_rows, 512):
                part = leaves[at : at + 512, : len(table)]
                # added up from the first tree on
                scores = np.cumsum(table[np.arange(len(table)), part], axis=1)[:, chosen] / share
                row = pa.array(np.repeat(np.arange(at, at + len(part)), len(chosen)))
                columns = [batch.column(0).take(row), batch.column(1).take(row), pa.array(np.tile(chosen, len(part)).astype(np.int32)), pa.array(scores.ravel())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "target", "stage", "score"])

    sent = leafed.select(F.col(key).alias("key"), F.col(target).alias("target"), LEAVES)
    kinds = {f.name: f.dataType.simpleString() for f in sent.schema}
    return sent.mapInArrow(score, f"key {kinds['key']}, target {kinds['target']}, stage int, score double")


def exact_metrics(leafed: DataFrame, values: LeafValues, key: str, target: str, stages: Sequence[int]) -> dict[int, float | None]:
    """Rank metric after the chosen stages (0-based), every row ranked."""
    long = materialize(stage_scores(leafed, values, key, target, stages), "stages")
    rows = rank_metric(long, "target", "score", "key", ["stage"]).collect()  # one row per stage
    return {r["stage"]: r["metric"] for r in rows}


def open_stages(bounds: Bounds, patience: int) -> list[int]:
    """Stages to rank before the course of the search is known: each one that may or may not pass
    the best before it, with that best."""
    low = high = -math.inf
    at, holder, wanted = 0, None, set()
    for i in sorted(bounds):
        lo, hi = bounds[i]
        if lo > high:
            low, high, at, holder = lo, hi, i, i
        elif hi > low:
            wanted.update(j for j in (i, holder) if j is not None and bounds[j][0] < bounds[j][1])
            holder = i if hi > high else holder
            # either may be the best, so patience counts from the later one
            low, high, at = max(low, lo), max(high, hi), i
        elif i - at >= patience:
            break
    return sorted(wanted)


def settled_best(bounds: Bounds, patience: int, exact: Callable[[list[int]], Mapping[int, float | None]], batch: int = 16) -> int:
    """Number of trees to keep: the best stage seen before ``patience`` stages without progress.

    ``bounds`` are narrowed by exact metrics, ``batch`` stages at a time from the first, until no open stage is left.
    """
    known = dict(bounds)
    while wanted := open_stages(known, patience)[:batch]:
        for stage, metric in exact(wanted).items():
            known[stage] = (metric, metric)
    best, at = -math.inf, 0
    for i in sorted(known):
        if known[i][0] > best:
            best, at = known[i][0], i
        elif i - at >= patience:
            break
    return at + 1


def best_stage(model, values: LeafValues, valid: DataFrame, key: str, target: str, patience: int, bins: int = BINS) -> int:
    """Trees to keep by the rank metric on validation rows (with ``features``)."""
    leafed = materialize(with_leaves(model, valid).select(key, target, LEAVES), "leaves")
    counts = stage_counts(leafed, values, target, range(len(values.values)), bins)
    rows = metric_bounds_of(counts, ["stage"]).collect()  # one row per stage
    # the closed form and the ranked sum may differ in the last places
    bounds = {r["stage"]: (r["lo"] - 1e-9, r["hi"] + 1e-9) for r in rows if r["lo"] is not None}
    return settled_best(bounds, patience, lambda stages: exact_metrics(leafed, values, key, target, stages)) if bounds else 1
