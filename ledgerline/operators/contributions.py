"""Additive contributions to a score, global drivers and reason codes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.describe import describe_feature
from ledgerline.functions.literals import double_text, quoted, rows_from
from ledgerline.functions.scores import finite_or, sigmoid

REASONS = 4
TERMS = 32


@dataclass(frozen=True)
class LinearScore:
    """A logistic score: intercept plus coefficient times deviation from the mean.

    A missing feature contributes nothing, as if it sat at its mean.
    """

    coefficients: Mapping[str, float]
    means: Mapping[str, float] = field(default_factory=dict)
    intercept: float = 0.0

    @property
    def features(self) -> list[str]:
        return list(self.coefficients)

    def contribution(self, feature: str) -> Column:
        deviation = F.col(feature).cast("double") - F.lit(float(self.means.get(feature, 0.0)))
        return F.coalesce(F.lit(float(self.coefficients[feature])) * deviation, F.lit(0.0))

    def contributions(self) -> dict[str, Column]:
        return {f: self.contribution(f) for f in self.coefficients}

    def logit(self) -> Column:
        # as text: one parse instead of several driver calls per feature; sums of sums, since one long
        # chain of additions is too deep for the analyser at full width
        parts = [double_text(self.intercept), *[
            f"coalesce({double_text(w)} * (CAST({quoted(f)} AS DOUBLE) - {double_text(self.means.get(f, 0.0))}), 0D)" for f, w in self.coefficients.items()]]
        while len(parts) > 1:
            parts = [f"({' + '.join(parts[i : i + TERMS])})" for i in range(0, len(parts), TERMS)]
        return F.expr(parts[0])

    def transform(self, features: DataFrame, out: str = "raw") -> DataFrame:
        return features.withColumn(out, sigmoid(self.logit()))


def fit_means(features: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Training means of the model's features: one row."""
    row = features.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns]).first()
    return {c: row[c] if row[c] is not None else 0.0 for c in columns}


def reason_codes(contributions: Mapping[str, Column], n: int = REASONS, positive_only: bool = True) -> Column:
    """The ``n`` largest finite contributions, as an array of reasons.

    Works inside the row: nothing is exploded or shuffled. Ties go by feature name.
    ``positive_only`` keeps those that push the risk up.
    """
    entries = F.array(
        *[
            F.struct(
                (-finite_or(c, 0.0)).alias("minus"),
                F.lit(f).alias("feature"),
                describe_feature(F.lit(f)).alias("description"),
            )
            for f, c in contributions.items()
        ]
    )
    kept = F.filter(entries, lambda e: e["minus"] < 0) if positive_only else entries
    top = F.slice(F.array_sort(kept), 1, n)
    return F.transform(
        top,
        lambda e: F.struct(
            e["feature"].alias("feature"),
            e["description"].alias("description"),
            F.round(-e["minus"], 4).alias("contribution"),
        ),
    )


def global_drivers(df: DataFrame, contributions: Mapping[str, Column], k: int = 15) -> DataFrame:
    """Features by mean absolute contribution, in one pass over the wide rows."""
    names = list(contributions)
    aggs = [F.avg(F.abs(contributions[f])).alias(f"c{i}") for i, f in enumerate(names)]
    rows = rows_from(names, {"mean_abs": "c"})
    return df.agg(*aggs).select(rows).orderBy(F.desc("mean_abs"), "feature").limit(k)


def riskiest_customers(df: DataFrame, logit: Column, key: str, k: int = 3) -> DataFrame:
    """The ``k`` customers with the highest logit."""
    return df.withColumn("logit", logit).orderBy(F.desc("logit"), key).limit(k)


def riskiest_reasons(
    df: DataFrame, logit: Column, contributions: Mapping[str, Column], key: str, k: int = 3, n: int = 5
) -> DataFrame:
    """The strongest contributions of the ``k`` riskiest customers, with the feature's value."""
    top = riskiest_customers(df, logit, key, k)
    reasons = reason_codes(contributions, n, positive_only=False)
    each = top.select("*", F.posexplode(reasons).alias("_at", "_reason"))
    value = F.coalesce(*[F.when(F.col("_reason.feature") == f, F.col(f).cast("double")) for f in contributions])
    return each.select(
        key,
        (F.col("_at") + 1).alias("position"),
        F.col("_reason.feature").alias("feature"),
        F.col("_reason.contribution").alias("contribution"),
        value.alias("value"),
    )
