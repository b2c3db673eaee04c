"""Path contributions of boosted trees, in vectorized batches.

The fitted trees are a model of bounded size (trees x nodes), broadcast to the tasks.
Each Arrow batch walks all its rows down a tree at once with NumPy.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FlatTree:
    """One tree as arrays; a leaf has feature -1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    weight: float


def flatten_trees(spark: SparkSession, path: str) -> list[FlatTree]:
    """The trees of a saved boosted classifier with continuous splits, from its node table."""
    n = F.col("nodeData")
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID", n["id"].alias("id"), n["split"]["featureIndex"].alias("feature"), n["split"]["leftCategoriesOrThreshold"].alias("threshold"),
        n["leftChild"].alias("left"), n["rightChild"].alias("right"), n["prediction"].alias("value"))
    weights = spark.read.parquet(f"{path}/treesMetadata").toDF("treeID", "_meta", "weight").drop("_meta")
    found = nodes.join(weights, "treeID").orderBy("treeID", "id").toPandas()  # as many rows as the model has nodes
    trees = []
    for _, t in found.groupby("treeID"):
        leaf = t["left"].to_numpy() < 0
        at = np.arange(len(t))
        threshold = np.array([0.0 if not len(x) else x[0] for x in t["threshold"]])
        # node numbers are places in the table
        trees.append(FlatTree(
            np.where(leaf, -1, t["feature"]), threshold, np.where(leaf, at, t["left"]), np.where(leaf, at, t["right"]),
            t["value"].to_numpy(), float(t["weight"].iloc[0])))
    return trees


def _walk(tree: FlatTree, x: np.ndarray, paths: np.ndarray | None = None) -> np.ndarray:
    """Leaf value of every row. Value changes along the way go to ``paths`` by feature."""
    rows = np.arange(len(x))
    node = np.zeros(len(x), dtype=int)
    while True:
        split = tree.feature[node] >= 0
        if not split.any():
            return tree.value[node]
        r, n = rows[split], node[split]
        f = tree.feature[n]
        step = np.where(x[r, f] <= tree.threshold[n], tree.left[n], tree.right[n])
        if paths is not None:
            paths[r, f] += tree.weight * (tree.value[step] - tree.value[n])
        node[split] = step


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.empty((0, 0))


def path_contributions(df: DataFrame, flat: Sequence[FlatTree], n_features: int, features: str = "features", out: str = "paths") -> DataFrame:
    """Adds each feature's additive share of the margin, plus the base value at the end.

    A split hands the change of node value to its feature, so base plus shares give
    the margin exactly.
    """
    trees = df.sparkSession.sparkContext.broadcast(list(flat))

    @F.pandas_udf("array<double>")
    def shares(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            x = _matrix(column)
            paths = np.zeros((len(x), n_features + 1))
            for t in trees.value:
                _walk(t, x, paths)
                paths[:, n_features] += t.weight * t.value[0]
            yield pd.Series(list(paths), index=column.index)

    return df.withColumn(out, shares(vector_to_array(F.col(features))))


def named_paths(names: Sequence[str], paths: str = "paths") -> dict[str, Column]:
    return {n: F.col(paths)[i] for i, n in enumerate(names)}
