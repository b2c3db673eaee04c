"""Standardized, padded statement sequences."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.literals import quoted, rows_from
from ledgerline.roles import Roles

# Sequence length, variance floor and clipping range.
MAX_STATEMENTS = 13
VARIANCE_FLOOR = 1e-12
CLIP = 10.0


def norm_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and population deviation of each column as (feature, mean, std) rows."""
    aggs = []
    for i, c in enumerate(columns):
        x = f"CAST({quoted(c)} AS DOUBLE)"
        aggs += [F.expr(f"avg({x}) AS m{i}"), F.expr(f"var_pop({x}) AS v{i}")]
    rows = df.agg(*aggs).select(rows_from(columns, {"feature_mean": "m", "variance": "v"}))
    std = F.sqrt(F.greatest(F.col("variance"), F.lit(VARIANCE_FLOOR)))
    return rows.select("feature", F.col("feature_mean").alias("mean"), F.when(F.col("variance").isNotNull(), std).alias("std"))


def stats_as_dict(stats: DataFrame) -> dict[str, tuple[float | None, float | None]]:
    """Fitted statistics on the driver: one row per column of the table."""
    return {r["feature"]: (r["mean"], r["std"]) for r in stats.collect()}


def standardize(column: str, mean: float | None, std: float | None) -> Column:
    """Scale, then NULL to 0, then clip: in that order."""
    if mean is None or std is None:
        return F.lit(0.0)
    z = (F.col(column).cast("double") - F.lit(mean)) / F.lit(std)
    return F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), F.coalesce(z, F.lit(0.0))))


def standardize_rows(
    df: DataFrame, stats: Mapping[str, tuple[float | None, float | None]], keep: Sequence[str]
) -> DataFrame:
    """Every fitted column standardized; ``keep`` passes through."""
    return df.select(*keep, *[standardize(c, *ms).alias(c) for c, ms in stats.items()])


def sequence_positions(df: DataFrame, roles: Roles, length: int = MAX_STATEMENTS) -> DataFrame:
    """Keep each customer's last ``length`` statements with their 0-based position, oldest first.

    The cut comes first: Spark applies it before the shuffle as well, so each task
    passes on at most ``length`` rows of a customer, however many it holds.
    """
    latest_first = Window.partitionBy(roles.key).orderBy(F.desc("_ord"))
    recent = (
        df.withColumn("_ord", roles.order_key(df))
        .withColumn("_back", F.row_number().over(latest_first))
        .where(F.col("_back") <= length)
    )
    kept = F.count(F.lit(1)).over(Window.partitionBy(roles.key))
    return (
        recent.withColumn("length", kept.cast("int"))
        .withColumn("pos", (F.col("length") - F.col("_back")).cast("int"))
        .drop("_ord", "_back")
    )


def padded_sequences(
    df: DataFrame, roles: Roles, columns: Sequence[str], length: int = MAX_STATEMENTS
) -> DataFrame:
    """One row per customer: ``seq`` of ``length`` feature vectors, zeros after ``length``."""
    placed = sequence_positions(df, roles, length)
    vector = F.array(*[F.col(c).cast("float") for c in columns])
    # at most ``length`` entries per customer
    steps = F.array_sort(F.collect_list(F.struct("pos", vector.alias("x"))))
    zeros = F.array_repeat(F.lit(0.0).cast("float"), len(columns))
    return (
        placed.groupBy(roles.key)
        .agg(F.first("length").alias("length"), steps.alias("_steps"))
        .select(
            roles.key,
            "length",
            F.concat(
                F.transform("_steps", lambda s: s["x"]),
                F.array_repeat(zeros, F.lit(length) - F.col("length")),
            ).alias("seq"),
        )
    )
