"""Search blend weights for the best rank metric."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.literals import double_matrix, int_array
from ledgerline.operators.rank_metrics import metric_bounds_of, rank_metric
from ledgerline.session import spread

# Grid sizes of the two searches.
TWO_WAY_STEPS = 51
THREE_WAY_STEPS = 41
PASSES = (2_048, 32_768)
FEW = 8


def two_way_grid(steps: int = TWO_WAY_STEPS) -> list[list[float]]:
    """Weights (w, 1-w). w = 1 comes first: it is the start value that others must beat."""
    ws = [1.0, *[float(w) for w in np.linspace(0, 1, steps)]]
    return [[w, 1 - w] for w in ws]


def three_way_grid(steps: int = THREE_WAY_STEPS, exact: bool = False) -> list[list[float]]:
    """Weights (a, b, 1-a-b) in search order.

    The number of ``b`` steps truncates a rounding error, so 14 values of ``a`` get
    one step less (847 points); ``exact`` gives the full simplex (861).
    """
    n = steps - 1
    grid = []
    for a in np.linspace(0, 1, steps):
        room = (1 - a) * n
        count = (round(room) if exact else int(room)) + 1
        for b in np.linspace(0, 1 - a, count):
            grid.append([float(a), float(b), float(1 - a - b)])
    return grid


def _blended(columns: Sequence[str]) -> Column:
    w = F.col("_w")
    total = w[0] * F.col(columns[0])
    for i, c in enumerate(columns[1:], 1):
        total = total + w[i] * F.col(c)
    return total


def _per_weight(df: DataFrame, columns: Sequence[str], grid: Sequence[Sequence[float]], ids: Sequence[int], keep: Sequence[str]) -> DataFrame:
    chosen = double_matrix([grid[i] for i in ids])
    numbers = int_array(ids)
    return (
        df.select(*keep, *columns, F.posexplode(chosen).alias("_at", "_w"))
        .select(*keep, F.element_at(numbers, F.col("_at") + 1).alias("weight_id"), _blended(columns).alias("blend"))
    )


def metric_bounds(
    df: DataFrame, columns: Sequence[str], grid: Sequence[Sequence[float]], ids: Sequence[int],
    target: str, low: float, high: float, bins: int,
) -> DataFrame:
    """Lower and upper bound of the metric per weight, from a histogram of the blend.

    Only the order inside a bin is unknown: defaults first is the best case, defaults
    last the worst. The rows are counted on the map side, so the shuffle carries
    weights x bins counters, not weights x rows.
    """
    width = (high - low) / bins or 1.0
    each = _per_weight(df, columns, grid, ids, [target])
    place = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("blend") - low) / width)))
    # a missing blend ranks below all others, so it has a cell of its own
    missing = F.col("blend").isNull() | F.isnan("blend")
    bin_ = F.when(missing, F.lit(-1)).otherwise(place).cast("int")
    cells = each.groupBy("weight_id", bin_.alias("_bin")).agg(
        F.sum(F.col(target).cast("long")).alias("p"), F.sum(1 - F.col(target).cast("long")).alias("g")
    )
    return metric_bounds_of(cells, ["weight_id"])


def evaluate_weights(
    df: DataFrame, columns: Sequence[str], grid: Sequence[Sequence[float]], ids: Sequence[int],
    target: str = "target", key: str = "customer_ID",
) -> DataFrame:
    """Exact metric of the chosen weights, as (weight_id, capture, gini, metric)."""
    each = _per_weight(df, columns, grid, ids, [key, target])
    return rank_metric(each, target, "blend", key, ["weight_id"])


def blend_search(
    df: DataFrame, columns: Sequence[str], grid: Sequence[Sequence[float]],
    target: str = "target", key: str = "customer_ID", passes: Sequence[int] = PASSES,
) -> DataFrame:
    """Best weights of the grid by the exact metric; an earlier point wins a tie.

    Histogram bounds rule out weights that cannot win; only the rest, usually a few
    neighbours of the optimum, are sorted row by row. ``df`` should be a stored table.
    """
    df = spread(df.select(key, target, *columns))
    present = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns]
    ends = df.agg(
        F.min(F.least(*present) if len(columns) > 1 else present[0]).alias("lo"),
        F.max(F.greatest(*present) if len(columns) > 1 else present[0]).alias("hi"),
    ).first()
    ids = list(range(len(grid)))
    if ends["lo"] is not None:
        for bins in passes:
            if len(ids) <= FEW:
                break
            found = metric_bounds(df, columns, grid, ids, target, float(ends["lo"]), float(ends["hi"]), bins)
            rows = found.where(F.col("hi").isNotNull()).collect()  # one row per grid point
            if not rows:
                break
            floor = max(r["lo"] for r in rows) - 1e-9
            ids = sorted(r["weight_id"] for r in rows if r["hi"] >= floor)
    scored = evaluate_weights(df, columns, grid, ids, target, key)
    weights = F.element_at(double_matrix(grid), F.col("weight_id") + 1)
    return (
        scored.orderBy(F.desc_nulls_last("metric"), "weight_id")
        .limit(1)
        .select(*[F.round(weights[i], 3).alias(f"w_{c}") for i, c in enumerate(columns)], "metric")
    )
