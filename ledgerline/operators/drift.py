"""Population stability index (PSI) of features and scores."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.literals import quoted
from ledgerline.operators.joins import lookup_join
from ledgerline.operators.ordered import exact_quantiles
from ledgerline.operators.wide_quantiles import bin_counts, exact_column_quantiles
from ledgerline.session import materialize, spread

# Smallest share, status thresholds and the verdict's tolerance.
MIN_SHARE = 1e-6
MODERATE, SHIFTED = 0.10, 0.25
SHIFTED_SHARE_LIMIT = 0.05


def stack_values(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Long form (feature, value) of the columns; missing values are left out."""
    numbers = df.selectExpr(*map(quoted, keep), *[f"CAST({quoted(c)} AS DOUBLE) AS {quoted(c)}" for c in columns])
    long = numbers.unpivot(list(keep), list(columns), "feature", "value")
    return long.where("value IS NOT NULL AND NOT isnan(value)")


def psi(expected: DataFrame, actual: DataFrame, by: Sequence[str], value: str = "value", bins: int = 10) -> DataFrame:
    """PSI of ``actual`` against ``expected`` per group: columns ``by`` and ``psi``.

    Bins are cut at the quantiles of ``expected``, open at both ends, lower edge
    inside. Only groups x bins counters are shuffled once the edges are known.
    A group that lacks one side has no PSI (NULL).
    """
    by = list(by)
    probs = np.linspace(0, 1, bins + 1).tolist()
    edges = exact_quantiles(expected, value, probs[1:-1] or [0.5], by)
    edges = materialize(edges.select(*by, F.col("q").alias("_q")), "edges")
    both = _present(expected, by, value, 0).unionByName(_present(actual, by, value, 1))
    bin_ = bin_index(F.col("_v"), [F.col("_q")[i] for i in range(bins - 1)])
    cells = lookup_join(both, edges, by, "left").select(*by, "_side", bin_.alias("_bin"))
    counts = cells.groupBy(*by).agg(
        *[
            F.expr(f"count_if(_side = {side} AND _bin = {i}) AS {name}{i}")
            for side, name in ((0, "e"), (1, "a"))
            for i in range(bins)
        ]
    )
    index = psi_of_counts([F.col(f"e{i}") for i in range(bins)], [F.col(f"a{i}") for i in range(bins)])
    return counts.select(*by, index.alias("psi"))


def bin_index(value: Column, inner_edges: Sequence[Column]) -> Column:
    """Number of inner edges at or below the value; equal edges merge their bins."""
    out = F.lit(0)
    for edge in inner_edges:
        out = out + F.coalesce(value >= edge, F.lit(False)).cast("int")
    return out


def psi_of_counts(expected: Sequence[Column], actual: Sequence[Column]) -> Column:
    """Index from bin counts of both sides; NULL when a side is empty."""
    n_e, n_a = sum(expected[1:], expected[0]), sum(actual[1:], actual[0])
    total = F.lit(0.0)
    for e, a in zip(expected, actual):
        share_e = F.greatest(e / F.nullif(n_e, F.lit(0)), F.lit(MIN_SHARE))
        share_a = F.greatest(a / F.nullif(n_a, F.lit(0)), F.lit(MIN_SHARE))
        total = total + (share_a - share_e) * F.ln(share_a / share_e)
    return F.when((n_e > 0) & (n_a > 0), total)


def _present(df: DataFrame, by: Sequence[str], value: str, side: int) -> DataFrame:
    v = F.col(value).cast("double")
    return df.where(v.isNotNull() & ~F.isnan(v)).select(*by, v.alias("_v"), F.lit(side).cast("long").alias("_side"))


def psi_features(expected: DataFrame, actual: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """PSI of every feature, as (feature, psi) rows, from the wide rows of both sides (stored tables).

    Two passes over ``expected`` find the edges, one over each side counts. A feature that lacks
    one side has no PSI (NULL).
    """
    expected, actual = spread(expected), spread(actual)
    probs = np.linspace(0, 1, bins + 1).tolist()[1:-1] or [0.5]
    edges = exact_column_quantiles(expected, columns, probs)
    edges = [e[: bins - 1] if e else [float("inf")] * (bins - 1) for e in edges]
    sides = [bin_counts(df, columns, edges).withColumn("side", F.lit(i)) for i, df in enumerate((expected, actual))]
    counts = sides[0].unionByName(sides[1]).groupBy("column").agg(*[
        F.coalesce(F.sum(F.when((F.col("side") == side) & (F.col("bin") == i), F.col("n"))), F.lit(0)).alias(f"{name}{i}")
        for side, name in ((0, "e"), (1, "a")) for i in range(bins)])
    names = expected.sparkSession.createDataFrame(list(enumerate(columns)), "column int, feature string")
    index = psi_of_counts([F.col(f"e{i}") for i in range(bins)], [F.col(f"a{i}") for i in range(bins)])
    return names.join(counts, "column", "left").select("feature", index.alias("psi"))


def psi_score(expected: DataFrame, actual: DataFrame, score: str, bins: int = 10) -> DataFrame:
    """PSI between two sets of predictions."""
    label = F.lit("score").alias("feature")
    return psi(
        expected.select(label, F.col(score).alias("value")),
        actual.select(label, F.col(score).alias("value")),
        ["feature"], "value", bins,
    ).select(F.col("psi").alias("score_psi"))


def windowed_psi(expected: DataFrame, actual: DataFrame, score: str, window: str, bins: int = 10) -> DataFrame:
    """PSI of logged scores against one training reference, per time window."""
    reference = reference_bins(expected, score, bins)
    if reference is None:
        return actual.groupBy(window).agg(F.lit(None).cast("double").alias("psi"))
    edges, base = reference
    return psi_of_counters(_counted(actual, [window], score, edges), window, base)


def reference_bins(expected: DataFrame, score: str, bins: int = 10) -> tuple[list[float], list[int]] | None:
    """Inner edges at the quantiles of a training reference, and its rows per bin; None without scores."""
    found = exact_quantiles(expected, score, np.linspace(0, 1, bins + 1).tolist()[1:-1] or [0.5]).first()
    if found is None:
        return None
    edges = [float(q) for q in found["q"][: bins - 1]]
    return edges, [int(n) for n in _counted(expected, [], score, edges).first()]


def _counted(df: DataFrame, by: Sequence[str], score: str, edges: Sequence[float]) -> DataFrame:
    bin_ = bin_index(F.col("_v"), [F.lit(e) for e in edges])
    return _present(df, by, score, 0).groupBy(*by).agg(
        *[F.count(F.when(bin_ == i, 1)).alias(f"b{i}") for i in range(len(edges) + 1)]
    )


def psi_of_counters(counters: DataFrame, window: str, base: Sequence[int]) -> DataFrame:
    """PSI per window from bin counters b0, b1, ... against the reference's rows per bin."""
    index = psi_of_counts([F.lit(n) for n in base], [F.col(f"b{i}") for i in range(len(base))])
    return counters.select(window, index.alias("psi"))


def psi_status(value: Column) -> Column:
    return F.when(value < MODERATE, "stable").when(value < SHIFTED, "moderate").when(value >= SHIFTED, "shifted")


def status_shares(table: DataFrame, score_psi: float | None = None) -> DataFrame:
    """Shares of stable, moderate and shifted features and the overall verdict.

    Features without a PSI are left out of the shares.
    """
    known = table.where(F.col("psi").isNotNull()).withColumn("_s", psi_status(F.col("psi")))
    share = {s: F.avg((F.col("_s") == s).cast("double")) for s in ("stable", "moderate", "shifted")}
    score_ok = F.lit(score_psi is None or score_psi < MODERATE)
    calm = (F.col("shifted") < SHIFTED_SHARE_LIMIT) & score_ok
    return known.agg(
        F.count(F.lit(1)).alias("features"), *[c.alias(s) for s, c in share.items()]
    ).withColumn("verdict", F.when(calm, "stable").otherwise("some drift"))


def top_drift(table: DataFrame, k: int = 10) -> DataFrame:
    known = table.where(F.col("psi").isNotNull())
    return known.orderBy(F.desc("psi"), "feature").limit(k)
