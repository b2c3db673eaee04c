"""Metrics of a ranking: weighted Gini, capture, KS, AUC.

``by`` evaluates many rankings (folds, blend weights, training stages) in one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.ordered import ROWS_PER_BUCKET, ordered_prefix

# Weight of a non-default, and the share of weight that is reviewed.
GOOD_WEIGHT = 20
TOP_SHARE = 0.04


def row_weight(target: str) -> Column:
    return F.when(F.col(target) == 0, F.lit(GOOD_WEIGHT)).otherwise(F.lit(1)).cast("long")


def ranked_by_score(
    df: DataFrame,
    target: str,
    score: str,
    key: str,
    by: Sequence[str] = (),
    descending: bool = True,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Rows in score order with running weight (``cum_w``) and running defaults (``cum_pos``)."""
    sums = {"w": row_weight(target), "pos": F.col(target).cast("long")}
    return ordered_prefix(
        df.select(*by, key, target, score), score, key, sums, by, descending, rows_per_bucket
    )


def gini_and_capture(area_pos: Column, area_w: Column, captured: Column, pos: Column, neg: Column) -> list[Column]:
    """Capture, normalized Gini and their mean from integer totals.

    The Gini sum over the ranking is ``area_pos / pos - area_w / weight``, where the
    areas add up (running defaults, running weight) times row weight. A perfect
    ranking has a closed form, so it needs no second sort.
    """
    weight = pos + GOOD_WEIGHT * neg
    gini_sum = F.try_divide(area_pos, pos) - F.try_divide(area_w, weight)
    perfect = F.try_divide(10 * neg * (pos + 20 * neg - 19), weight)
    gini = F.try_divide(gini_sum, perfect)
    capture = F.try_divide(captured, pos)
    return [capture.alias("capture"), gini.alias("gini"), ((gini + capture) / 2).alias("metric")]


def rank_metric(
    df: DataFrame,
    target: str = "target",
    score: str = "prediction",
    key: str = "customer_ID",
    by: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Default capture in the top 4 % of weight, normalized weighted Gini, and their mean.

    Sums stay exact (decimal), so equal rankings give equal metrics whatever the
    partitioning. Without positives or without negatives the result is NULL.
    """
    ranked = ranked_by_score(df, target, score, key, by, True, rows_per_bucket)
    exact = "decimal(38,0)"
    w = row_weight(target)
    inside = F.col("cum_w") <= TOP_SHARE * F.col("tot_w")
    sums = ranked.groupBy(*by).agg(
        F.sum((F.col("cum_pos") * w).cast("decimal(20,0)")).cast(exact).alias("area_pos"),
        F.sum((F.col("cum_w") * w).cast("decimal(20,0)")).cast(exact).alias("area_w"),
        F.count(F.when(inside & (F.col(target) == 1), 1)).alias("captured"),
        F.count(F.when(F.col(target) == 1, 1)).alias("pos"),
        F.count(F.when(F.col(target) == 0, 1)).alias("neg"),
    )
    wide = {c: F.col(c).cast("double") for c in ("area_pos", "area_w", "captured", "pos", "neg")}
    return sums.select(
        *by,
        *gini_and_capture(wide["area_pos"], wide["area_w"], wide["captured"], wide["pos"], wide["neg"]),
    )


def metric_bounds_of(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Lower and upper bound (``lo``, ``hi``) of the metric per group, from positives ``p`` and negatives ``g``
    per cell ``_bin`` of the score.

    Only the order inside a cell is unknown: defaults first is the best case, defaults last the worst.
    """
    # as many rows per group as it has bins
    down = Window.partitionBy(*by).orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    w = F.col("p") + GOOD_WEIGHT * F.col("g")
    cells = cells.select(
        *by, "p", "g",
        F.coalesce(F.sum("p").over(down), F.lit(0)).alias("p0"),
        F.coalesce(F.sum(w).over(down), F.lit(0)).alias("w0"),
        F.sum("p").over(whole).alias("pos"),
        F.sum("g").over(whole).alias("neg"),
    )
    p, g, p0, w0 = (F.col(c).cast("double") for c in ("p", "g", "p0", "w0"))
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    weight = pos + GOOD_WEIGHT * neg
    climb = p0 * p + p * (p + 1) / 2
    room = TOP_SHARE * weight - w0
    taken = {
        "hi": F.least(p, F.greatest(F.lit(0.0), F.floor(room))),
        "lo": F.least(p, F.greatest(F.lit(0.0), F.floor(room - GOOD_WEIGHT * g))),
    }
    area = {"hi": climb + GOOD_WEIGHT * g * (p0 + p), "lo": climb + GOOD_WEIGHT * g * p0}
    sums = cells.groupBy(*by).agg(
        F.first(pos).alias("pos"), F.first(neg).alias("neg"),
        *[F.sum(area[e]).alias(f"area_{e}") for e in area],
        *[F.sum(taken[e]).alias(f"taken_{e}") for e in taken],
    )
    pos, neg = F.col("pos"), F.col("neg")
    weight = pos + GOOD_WEIGHT * neg
    # the sum of running weight times row weight does not depend on the order
    area_w = (weight * weight + pos + GOOD_WEIGHT**2 * neg) / 2
    bounds = {
        e: gini_and_capture(F.col(f"area_{e}"), area_w, F.col(f"taken_{e}"), pos, neg)[2].alias(e) for e in area
    }
    return sums.select(*by, bounds["lo"], bounds["hi"])


def by_distinct_score(
    df: DataFrame, target: str, score: str, by: Sequence[str] = (), rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """One row per distinct score with running counts. Ties collapse before the shuffle."""
    collapsed = df.groupBy(*by, score).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col(target).cast("long")).alias("bad")
    )
    sums = {"rows": F.col("rows"), "bad": F.col("bad")}
    return ordered_prefix(collapsed, score, None, sums, by, False, rows_per_bucket)


def ks_statistic(
    df: DataFrame,
    target: str = "target",
    score: str = "prediction",
    by: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Largest gap between the cumulative shares of bads and goods, at distinct scores."""
    curve = by_distinct_score(df, target, score, by, rows_per_bucket)
    goods = F.col("cum_rows") - F.col("cum_bad")
    all_goods = F.col("tot_rows") - F.col("tot_bad")
    gap = F.try_divide(F.col("cum_bad"), F.col("tot_bad")) - F.try_divide(goods, all_goods)
    return curve.groupBy(*by).agg(F.max(F.abs(gap)).alias("ks"))


def auc_gini(
    df: DataFrame,
    target: str = "target",
    score: str = "prediction",
    by: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """ROC-AUC with tied scores averaged, and Gini = 2 AUC - 1."""
    curve = by_distinct_score(df, target, score, by, rows_per_bucket)
    # twice the mean rank of a tie group, kept whole
    twice_rank = 2 * F.col("cum_rows") - F.col("rows") + 1
    sums = curve.groupBy(*by).agg(
        F.sum((F.col("bad") * twice_rank).cast("decimal(20,0)")).cast("double").alias("twice_sum"),
        F.first("tot_bad").cast("double").alias("p"),
        (F.first("tot_rows") - F.first("tot_bad")).cast("double").alias("q"),
    )
    p, q = F.col("p"), F.col("q")
    auc = F.try_divide(F.col("twice_sum") / 2 - p * (p + 1) / 2, p * q)
    return sums.select(*by, auc.alias("auc"), (2 * auc - 1).alias("gini"))
