"""Column expressions on scores and outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Risk bands (upper limit, name), histogram limits.
RISK_BANDS = ((0.05, "very low"), (0.20, "low"), (0.50, "medium"), (0.80, "high"))
TOP_BAND = "very high"
PD_LIMITS = (0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9, 1.0)


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def risk_band(pd: Column) -> Column:
    """Band of an unrounded calibrated probability."""
    out = F.when(pd < RISK_BANDS[0][0], RISK_BANDS[0][1])
    for limit, name in RISK_BANDS[1:]:
        out = out.when(pd < limit, name)
    return out.otherwise(TOP_BAND)


def finite_or(value: Column, default: float | None = None) -> Column:
    """NULL, NaN and infinities replaced by ``default``."""
    x = value.cast("double")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when(finite, x).otherwise(F.lit(default).cast("double"))


def clean_nonfinite(df: DataFrame) -> DataFrame:
    """Non-finite numbers become NULL, inside arrays of numbers as well."""
    def cleaned(name: str, dtype: str) -> Column:
        if dtype in ("float", "double"):
            return finite_or(F.col(name)).cast(dtype).alias(name)
        if dtype in ("array<float>", "array<double>"):
            return F.transform(name, lambda x: finite_or(x)).cast(dtype).alias(name)
        return F.col(name)

    return df.select(*[cleaned(c, t) for c, t in df.dtypes])


def linear_blend(parts: Sequence[tuple[float | Column, Column]]) -> Column:
    """Weighted sum of predictions."""
    total = None
    for weight, column in parts:
        term = (weight if isinstance(weight, Column) else F.lit(float(weight))) * column
        total = term if total is None else total + term
    return total


def recover_component(blend: Column, known: Column, weight: float = 0.86) -> Column:
    """The second prediction of a two-way blend, from the blend and the first one."""
    return (blend - F.lit(weight) * known) / F.lit(1 - weight)


def ensemble_mean(columns: Sequence[Column]) -> Column:
    """Average of fold-model predictions."""
    total = columns[0] / len(columns)
    for c in columns[1:]:
        total = total + c / len(columns)
    return total


def prediction_stats(df: DataFrame, score: str) -> DataFrame:
    return df.agg(
        F.count(score).alias("n"), F.min(score).alias("min"), F.avg(score).alias("mean"), F.max(score).alias("max")
    )


def pd_histogram(pd: Column, limits: Sequence[float] = PD_LIMITS) -> list[Column]:
    """Cumulative counters ``le_<limit>`` plus count and sum, as aggregates."""
    counters = [F.count(F.when(pd <= x, 1)).alias(f"le_{str(x).replace('.', '_')}") for x in limits]
    return [F.count(pd).alias("scored"), F.sum(pd).alias("pd_sum"), *counters]


def portfolio_stats(scored: DataFrame, pd: str = "probability_of_default", threshold: float = 0.5) -> DataFrame:
    """Customers scored and share at or above the threshold."""
    return scored.agg(
        F.count(F.lit(1)).alias("customers"),
        F.avg((F.col(pd) >= threshold).cast("double")).alias("share_high_risk"),
        F.avg(pd).alias("mean_pd"),
    )
