"""Credit-model evaluation tables: score bands, reliability, approval, Brier."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.ordered import ROWS_PER_BUCKET, exact_quantiles, ordered_prefix
from ledgerline.operators.rank_metrics import auc_gini, ks_statistic, rank_metric


def rank_bin(rank: Column, n: Column, bins: int) -> Column:
    """Quantile bin (1-based, ascending) of a 1-based rank among ``n`` rows."""
    share = (rank - 1) * bins / F.greatest(n - 1, F.lit(1))
    return F.greatest(F.lit(1), F.ceil(share)).cast("int")


def quantile_bins(
    df: DataFrame, score: str, key: str, bins: int = 10, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Every row with its rank and its quantile bin; ties broken, so bins are even."""
    ranked = ordered_prefix(df, score, key, rows_per_bucket=rows_per_bucket)
    return ranked.withColumn("bin", rank_bin(F.col("rank"), F.col("n"), bins))


def score_bands(
    df: DataFrame,
    target: str = "target",
    score: str = "prediction",
    key: str = "customer_ID",
    bins: int = 10,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Band table, band 1 = highest predicted risk. Shares are fractions, not percent."""
    binned = quantile_bins(df.select(key, target, score), score, key, bins, rows_per_bucket)
    bands = binned.groupBy((bins + 1 - F.col("bin")).alias("band")).agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum(F.col(target).cast("long")).alias("defaults"),
        F.avg(score).alias("avg_pred"),
    )
    # at most ``bins`` rows from here on
    down = Window.orderBy("band").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    return bands.select(
        "band",
        "customers",
        "defaults",
        "avg_pred",
        (F.col("defaults") / F.col("customers")).alias("bad_rate"),
        F.try_divide(F.sum("defaults").over(down), F.sum("defaults").over(everything)).alias("cum_defaults"),
    )


def calibration_curve(
    df: DataFrame, target: str = "target", score: str = "prediction", bins: int = 20
) -> DataFrame:
    """Mean prediction against observed rate in quantile bins; empty bins are absent.

    A score equal to an inner edge belongs to the lower bin.
    """
    probs = (np.linspace(0, 1, bins + 1) * 100 / 100).tolist()
    found = exact_quantiles(df, score, probs).first()
    edges = found["q"][1:-1] if found else []
    above = sum(((F.col(score) > float(e)).cast("int") for e in edges), F.lit(0))
    return (
        df.where(F.col(score).isNotNull())
        .groupBy((above + 1).alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("customers"),
            F.avg(score).alias("mean_pred"),
            F.avg(F.col(target).cast("double")).alias("observed_rate"),
        )
    )


def approval_curve(
    df: DataFrame,
    target: str = "target",
    score: str = "prediction",
    key: str = "customer_ID",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Approve lowest risk first: approval rate and bad rate among the approved, per row."""
    sums = {"bad": F.col(target).cast("long")}
    ranked = ordered_prefix(df.select(key, target, score), score, key, sums, rows_per_bucket=rows_per_bucket)
    return ranked.select(
        key,
        "rank",
        "n",
        (F.col("rank") / F.col("n")).alias("approval_rate"),
        (F.col("cum_bad") / F.col("rank")).alias("bad_rate"),
    )


def approval_points(curve: DataFrame, rates: Sequence[float] = (0.5, 0.7, 0.9)) -> DataFrame:
    """The approval curve read off at the given approval rates."""
    at = F.filter(F.lit([float(r) for r in rates]), lambda a: F.floor(a * F.col("n")) == F.col("rank"))
    return curve.select(F.explode(at).alias("approved"), "rank", "bad_rate")


def brier(df: DataFrame, target: str, scores: Sequence[str]) -> DataFrame:
    """Mean squared error of each score column."""
    return df.agg(*[F.avg(F.pow(F.col(s) - F.col(target), 2)).alias(f"brier_{s}") for s in scores])


def calibration_verdict(brier_raw: Column, brier_calibrated: Column) -> Column:
    return F.when(brier_calibrated < brier_raw, "better").otherwise("worse")


def risk_report(
    df: DataFrame,
    target: str = "target",
    score: str = "prediction",
    calibrated: str | None = None,
    key: str = "customer_ID",
) -> DataFrame:
    """Headline metrics as (metric, value) rows; ``df`` should be a stored table."""
    scores = [score] + ([calibrated] if calibrated else [])
    base = df.agg(
        F.count(F.lit(1)).cast("double").alias("customers"),
        F.avg(F.col(target).cast("double")).alias("default_rate"),
        *[F.avg(F.pow(F.col(s) - F.col(target), 2)).alias(f"brier_{s}") for s in scores],
    )
    parts = [
        rank_metric(df, target, score, key),
        auc_gini(df, target, score).withColumnRenamed("gini", "auc_gini"),
        ks_statistic(df, target, score),
        base,
    ]
    rows = [p.unpivot([], p.columns, "metric", "value") for p in parts]
    report = rows[0]
    for r in rows[1:]:
        report = report.unionByName(r)
    return report


def full_report(
    df: DataFrame,
    target: str = "target",
    score: str = "prediction",
    calibrated: str = "calibrated",
    key: str = "customer_ID",
    bins: int = 10,
    curve_bins: int = 20,
    rates: Sequence[float] = (0.5, 0.7, 0.9),
) -> DataFrame:
    """Everything a model review reads, as (section, item, metric, value) rows; ``df`` should be a stored table.

    Sections: ``headline`` (no item), ``bands`` by band, ``raw_curve`` and ``calibrated_curve`` by bin, ``approval`` by
    approval rate. Each table is made distributed and small before it is turned into rows.
    """
    tables = {
        "bands": (score_bands(df, target, score, key, bins), "band"),
        "raw_curve": (calibration_curve(df, target, score, curve_bins), "bin"),
        "calibrated_curve": (calibration_curve(df, target, calibrated, curve_bins), "bin"),
        "approval": (approval_points(approval_curve(df, target, score, key), rates), "approved"),
    }
    headline = risk_report(df, target, score, calibrated, key)
    report = headline.select(F.lit("headline").alias("section"), F.lit(None).cast("double").alias("item"), "metric", "value")
    for name, (table, item) in tables.items():
        metrics = [c for c in table.columns if c != item]
        numbers = table.select(F.col(item).cast("double").alias("item"), *[F.col(c).cast("double").alias(c) for c in metrics])
        rows = numbers.unpivot(["item"], metrics, "metric", "value")
        report = report.unionByName(rows.withColumn("section", F.lit(name)))
    return report
