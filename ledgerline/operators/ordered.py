"""Global order at scale: running totals and exact quantiles without one huge task."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.literals import double_array, int_array
from ledgerline.operators.joins import lookup_join
from ledgerline.session import materialize

ROWS_PER_BUCKET = 500_000
GRID = 1_000
_HEX_DIGITS = 7


def tie_break(key: str | None) -> list[Column]:
    """Order of rows with equal value. A hash of the key is uniform, so a value shared
    by very many rows can be cut into even pieces along it."""
    return [_hash(key), F.col(key)] if key else []


def _hash(key: str) -> Column:
    return F.md5(F.col(key).cast("string"))


def ordered_prefix(
    df: DataFrame,
    value: str | Column,
    key: str | None,
    sums: Mapping[str, Column] | None = None,
    by: Sequence[str] = (),
    descending: bool = False,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Rank and running totals in the order of ``value``, over the whole table.

    Adds ``rank`` (1-based), ``n`` (group size) and, for every entry of ``sums``,
    ``cum_<name>`` and ``tot_<name>``; all within the groups of ``by`` (columns without
    NULLs). Equal values are ordered by a hash of ``key``, then by ``key``. NULL and NaN sort lowest.

    The rows are cut into buckets at approximate quantiles of ``value``, which are
    plain numbers in the plan: a recomputed task finds the same bucket. A value so
    frequent that it fills several buckets is cut again along the hash of its key.
    Bucket totals (one small row each) give every bucket its starting offset, and a
    window inside the bucket does the rest. ``df`` is read three times: hand in a
    stored table when it is costly.
    """
    sums = dict(sums or {})
    by = list(by)
    score = F.col(value) if isinstance(value, str) else value
    score = score.cast("double")
    low = F.lit(float("-inf"))
    base = df.withColumn("_v", F.when(score.isNull() | F.isnan(score), low).otherwise(score))
    base = base.select("*", *[c.alias(f"_x_{name}") for name, c in sums.items()])

    splits, pieces = _cut_points(base, rows_per_bucket)
    if not splits:
        framed = base.withColumn("_bucket", F.lit(0)).withColumn("_piece", F.lit(0))
    else:
        cut = Bucketizer(splits=splits, inputCol="_v", outputCol="_bucket")
        framed = cut.transform(base).withColumn("_bucket", F.col("_bucket").cast("int"))
        framed = framed.withColumn("_piece", _piece(key, pieces))

    tie = [c.asc() for c in tie_break(key)]
    in_order = F.col("_v").desc() if descending else F.col("_v").asc()
    cell = [*by, "_bucket", "_piece"]
    inside = Window.partitionBy(*cell).orderBy(in_order, *tie)
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    measured = ["_n", *[f"_s_{s}" for s in sums]]
    if not splits:
        whole = Window.partitionBy(*cell)
        joined = framed.select(
            "*",
            *[F.lit(0).alias(f"_before{m}") for m in measured],
            F.count(F.lit(1)).over(whole).alias("_all_n"),
            *[F.sum(f"_x_{s}").over(whole).alias(f"_all_s_{s}") for s in sums],
        )
    else:
        totals = framed.groupBy(*cell).agg(
            F.count(F.lit(1)).alias("_n"), *[F.sum(f"_x_{s}").alias(f"_s_{s}") for s in sums]
        )
        # one row per bucket and group
        bucket_order = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
        over = Window.partitionBy(*by)
        before = over.orderBy(bucket_order, F.col("_piece")).rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select(
            *cell,
            *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"_before{m}") for m in measured],
            *[F.sum(m).over(over).alias(f"_all{m}") for m in measured],
        )
        joined = framed.join(offsets, cell)
    return joined.select(
        *df.columns,
        (F.col("_before_n") + F.row_number().over(inside)).cast("long").alias("rank"),
        F.col("_all_n").alias("n"),
        *[(F.col(f"_before_s_{s}") + F.sum(f"_x_{s}").over(running)).alias(f"cum_{s}") for s in sums],
        *[F.col(f"_all_s_{s}").alias(f"tot_{s}") for s in sums],
    )


def _cut_points(base: DataFrame, rows_per_bucket: int) -> tuple[list[float], list[int]]:
    """Bucket edges and the number of pieces per bucket; none for an empty table."""
    # finer on a larger cluster, so that the number of tasks has no fixed limit
    points = max(GRID, 4 * int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    grid = [i / points for i in range(1, points)]
    found = base.agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("_v", double_array(grid), 4 * points).alias("q")
    ).first()
    if not found["n"]:
        return [], []
    # never one bucket alone: a small table takes the same path as a large one
    buckets = min(points, max(2, math.ceil(found["n"] / rows_per_bucket)))
    edges = [found["q"][min(len(grid) - 1, round(points * i / buckets) - 1)] for i in range(1, buckets)]
    return _splits(edges)


def _splits(edges: Sequence[float]) -> tuple[list[float], list[int]]:
    """Strictly increasing splits. A value filling several buckets gets one of its own."""
    inf = float("inf")
    splits, pieces = [-inf], [1]
    for edge in sorted(set(edges)):
        times = edges.count(edge)
        if edge == -inf or edge == inf:
            continue
        if edge > splits[-1]:
            splits.append(edge)
            pieces.append(times)
        else:
            pieces[-1] = max(pieces[-1], times)
        if times > 1:
            splits.append(math.nextafter(edge, inf))
            pieces.append(1)
    if edges.count(-inf) > 1:
        # the lowest bucket holds the missing scores
        pieces[0] = edges.count(-inf)
        lowest = math.nextafter(-inf, inf)
        if splits[-1] == -inf or splits[1] != lowest:
            splits.insert(1, lowest)
            pieces.insert(1, 1)
    splits.append(inf)
    if len(splits) < 3:
        return [], []
    return splits, pieces


def _piece(key: str | None, pieces: Sequence[int]) -> Column:
    """Even slices of the hash range, in hash order, for the buckets that need them."""
    if key is None or max(pieces) == 1:
        return F.lit(0)
    slices = F.element_at(int_array(pieces), F.col("_bucket") + 1)
    position = F.conv(F.substring(_hash(key), 1, _HEX_DIGITS), 16, 10).cast("long")
    return F.when(slices == 1, F.lit(0)).otherwise(
        F.floor(position * slices / F.lit(16**_HEX_DIGITS)).cast("int")
    )


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    accuracy: int = 10_000,
) -> DataFrame:
    """Exact linear-interpolation quantiles per group: columns ``n`` and ``q`` (array).

    A mergeable sketch first brackets every wanted rank between two values. Only the
    distinct values inside the brackets are then counted and sorted, so the shuffle
    carries a few times ``1 / accuracy`` of the rows instead of all of them. NULL and
    NaN are left out. ``df`` is read twice.
    """
    by = list(by)
    groups = by or ["_all"]
    source = df if by else df.withColumn("_all", F.lit(0))
    clean = source.select(*groups, F.col(value).cast("double").alias("_v"))
    clean = clean.where(F.col("_v").isNotNull() & ~F.isnan("_v"))

    probs = [float(p) for p in probs]
    margin = 3 / accuracy
    wanted = sorted({q for p in probs for q in (p - margin, p + margin) if 0 < q < 1})
    spot = {q: i for i, q in enumerate(wanted)}

    def end(q: float, beyond: float) -> Column:
        # up to ``accuracy`` rows the margin is less than a few ranks: take them all
        if q not in spot:
            return F.lit(beyond)
        return F.when(F.col("n") <= accuracy, F.lit(beyond)).otherwise(F.col("_b")[spot[q]])

    def bracket(p: float) -> Column:
        low, high = end(p - margin, float("-inf")), end(p + margin, float("inf"))
        return F.struct(low.alias("low"), high.alias("high"))

    sketch = clean.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("_v", double_array(wanted or [0.5]), accuracy).alias("_b")
    )
    fitted = sketch.select(*groups, "n", F.array(*[bracket(p) for p in probs]).alias("_brackets"))
    fitted = materialize(fitted, "brackets")

    # NULL gathers everything below a bracket, so it sorts first and carries its count
    entries = ", ".join(
        f"CASE WHEN _v <= _brackets[{i}].high THEN"
        f" named_struct('_i', {i}, '_u', CASE WHEN _v >= _brackets[{i}].low THEN _v END) END"
        for i in range(len(probs))
    )
    counted = (
        lookup_join(clean, fitted, groups)
        .select(*groups, "n", F.expr(f"inline(array({entries}))"))
        .where("_i IS NOT NULL")
        .groupBy(*groups, "n", "_i", F.col("_u").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    ahead = Window.partitionBy(*groups, "n", "_i").orderBy(F.col("_v").asc_nulls_first())
    upto = F.sum("_c").over(ahead.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    position = F.element_at(double_array(probs), F.col("_i") + 1) * (F.col("n") - 1)
    # what lies below the bracket sorts first and is told apart from a real minus infinity
    found = F.struct(F.col("_v").isNotNull().alias("inside"), F.col("_v").alias("v"))
    picked = (
        counted.select(*groups, "n", "_i", "_v", upto.alias("_upto"), position.alias("_h"))
        .groupBy(*groups, "n", "_i", "_h")
        .agg(
            # the smallest values reached by the two ranks around the position
            F.min(F.when(F.col("_upto") > F.floor("_h"), found)).alias("lo"),
            F.min(F.when(F.col("_upto") > F.ceil("_h"), found)).alias("hi"),
        )
    )
    t = F.col("_h") - F.floor("_h")
    lo, hi = F.col("lo.v"), F.col("hi.v")
    between = F.when(lo == hi, lo).when(t < 0.5, lo + (hi - lo) * t).otherwise(hi - (hi - lo) * (1 - t))
    # a rank outside its bracket fails the query rather than giving a wrong quantile
    outside = F.col("lo").isNull() | F.col("hi").isNull() | ~F.col("lo.inside")
    checked = F.when(outside, F.raise_error(F.lit("quantile outside its bracket")).cast("double")).otherwise(between)
    # one entry per wanted probability
    slots = F.array_sort(F.collect_list(F.struct("_i", checked.alias("q"))))
    out = picked.groupBy(*groups, "n").agg(slots.alias("_s"))
    return out.select(*by, "n", F.transform("_s", lambda s: s["q"]).alias("q"))
