"""Pick example customers across the risk spectrum."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Preset labels and target probabilities, in picking order.
PRESETS = {
    "Very low risk": 0.02, "Low risk": 0.12, "Medium risk": 0.35,
    "High risk": 0.65, "Very high risk": 0.93,
}


def nearest_candidates(scored: DataFrame, key: str, score: str, targets: Mapping[str, float], k: int) -> DataFrame:
    """The ``k`` customers nearest to each target.

    The targets are a few constants. The cut to ``k`` is applied before the shuffle
    as well, so each task passes on at most ``k`` rows per target.
    """
    wanted = F.array(*[F.struct(F.lit(n).alias("label"), F.lit(float(t)).alias("wanted")) for n, t in targets.items()])
    each = scored.where(F.col(score).isNotNull()).select(key, score, F.inline(wanted))
    gap = F.abs(F.col(score) - F.col("wanted"))
    nearest = Window.partitionBy("label").orderBy(gap, key)
    return each.withColumn("rn", F.row_number().over(nearest)).where(F.col("rn") <= k)


def pick_presets(
    scored: DataFrame, key: str = "customer_id", score: str = "probability_of_default",
    targets: Mapping[str, float] = PRESETS,
) -> DataFrame:
    """For each target, in order, the nearest customer not yet taken.

    Earlier targets can take at most ``len(targets) - 1`` customers, so that many
    candidates plus one per target settle it: a bounded handful on the driver.
    """
    near = nearest_candidates(scored, key, score, targets, len(targets)).orderBy("label", "rn").collect()
    taken: set = set()
    rows = []
    for label, wanted in targets.items():
        mine = [r for r in near if r["label"] == label and r[key] not in taken]
        if mine:
            taken.add(mine[0][key])
            rows.append((label, wanted, mine[0][key], mine[0][score]))
    return scored.sparkSession.createDataFrame(rows, f"label string, wanted double, {key} string, {score} double")
