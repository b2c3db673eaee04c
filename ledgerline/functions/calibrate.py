"""Apply a fitted calibration curve."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.literals import double_array

LITERAL_KNOTS = 2_000


def calibrate(df: DataFrame, score: str, x: Sequence[float], y: Sequence[float], out: str) -> DataFrame:
    """Piecewise-linear interpolation between knots (x strictly increasing), flat beyond them.

    The knots are a fitted curve, not data. A short curve lives in the plan and is
    looked up by binary search in the JVM; a long one is broadcast to Arrow batches.
    """
    x, y = [float(v) for v in x], [float(v) for v in y]
    if len(x) != len(y) or not x or any(b <= a for a, b in zip(x, x[1:])):
        raise ValueError("knots must be non-empty with strictly increasing x")
    if len(x) > LITERAL_KNOTS:
        return _calibrate_batches(df, score, x, y, out)
    inf = float("inf")
    cut = Bucketizer(splits=[-inf, *x, inf], inputCol="_p", outputCol="_knot", handleInvalid="keep")
    placed = cut.transform(df.withColumn("_p", F.col(score).cast("double")))
    m = len(x)
    slopes = [(y[i + 1] - y[i]) / (x[i + 1] - x[i]) for i in range(m - 1)] + [0.0]
    at = F.col("_knot").cast("int")
    p = F.col("_p")
    inner = F.get(double_array(slopes), at - 1) * (p - F.get(double_array(x), at - 1)) + F.get(double_array(y), at - 1)
    value = (
        F.when(p.isNull() | F.isnan(p), None)
        .when(at == 0, y[0])
        .when(at >= m, y[-1])
        .otherwise(inner)
    )
    return placed.select(*[c for c in df.columns if c != out], value.cast("double").alias(out))


def _calibrate_batches(df: DataFrame, score: str, x: list[float], y: list[float], out: str) -> DataFrame:
    knots = df.sparkSession.sparkContext.broadcast((np.array(x), np.array(y)))

    @F.pandas_udf("double")
    def interpolate(p: pd.Series) -> pd.Series:
        xs, ys = knots.value
        return pd.Series(np.interp(p.to_numpy(float), xs, ys), index=p.index).where(p.notna())

    return df.withColumn(out, interpolate(F.col(score).cast("double")))
