"""Deterministic stratified splits.

A row's place depends on a hash of seed and key, not on file order or partitioning,
so every model and every rerun sees the same folds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.ordered import ROWS_PER_BUCKET, ordered_prefix
from ledgerline.roles import FOLDS, SEED


def _shuffled(
    df: DataFrame, key: str, seed: int, by: Sequence[str] = (), rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    # 52 bits: every value is exact as a double
    place = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")
    return ordered_prefix(df, place, key, by=by, rows_per_bucket=rows_per_bucket)


def stratified_folds(
    df: DataFrame,
    key: str = "customer_ID",
    target: str = "target",
    k: int = FOLDS,
    seed: int = SEED,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Adds ``fold`` in 0..k-1; each class is spread evenly over the folds."""
    ranked = _shuffled(df, key, seed, [target], rows_per_bucket)
    return ranked.select(*df.columns, F.pmod(F.col("rank") - 1, F.lit(k)).cast("int").alias("fold"))


def stratified_holdout(
    df: DataFrame, key: str = "customer_ID", target: str = "target", share: float = 0.1, seed: int = SEED
) -> DataFrame:
    """Adds ``is_holdout``: ``share`` of each class, rounded up."""
    ranked = _shuffled(df, key, seed, [target])
    return ranked.select(*df.columns, (F.col("rank") <= F.ceil(F.lit(share) * F.col("n"))).alias("is_holdout"))


def random_halves(df: DataFrame, key: str = "customer_ID", seed: int = SEED) -> DataFrame:
    """Adds ``half`` 0/1: the first half (rounded down) and the rest."""
    ranked = _shuffled(df, key, seed)
    return ranked.select(*df.columns, (F.col("rank") > F.floor(F.col("n") / 2)).cast("int").alias("half"))
