"""Equi-joins against lookup tables, with the broadcast decided by a size check."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.session import materialize

HOT_SHARE = 2_000


def estimated_bytes(df: DataFrame) -> int:
    """Spark's own upper estimate of the size of ``df``; no job is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_limit(spark: SparkSession) -> int:
    """The session's threshold for automatic broadcasts, in bytes."""
    return int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())


def hot_keys(df: DataFrame, on: Sequence[str], share: int = HOT_SHARE) -> DataFrame:
    """Keys holding more than ``1 / share`` of the rows: fewer than ``share`` of them."""
    counts = df.where(_complete(on)).groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    counts = materialize(counts, "key_counts")
    total = counts.agg(F.sum("_rows")).first()[0] or 0
    return counts.where(F.col("_rows") * share > total).select(*on)


def lookup_join(
    left: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    max_bytes: int | None = None,
    share: int = HOT_SHARE,
) -> DataFrame:
    """Join a large, possibly skewed ``left`` to a lookup with one row per key.

    A lookup that Spark's statistics put within ``max_bytes`` (by default the session's
    broadcast threshold) is broadcast, so ``left`` is not moved at all. Beyond that size, the few keys that are frequent in ``left`` meet their lookup rows by
    broadcast, and only the evenly spread rest is shuffled. Rows with a NULL key match
    nothing and are not shuffled either. ``how``: inner, left, left_semi, left_anti.
    """
    on = list(on)
    limit = broadcast_limit(left.sparkSession) if max_bytes is None else max_bytes
    if estimated_bytes(lookup) <= limit:
        return left.join(F.broadcast(lookup), on, how)
    hot = F.broadcast(hot_keys(left, on, share))
    present = left.where(_complete(on))
    frequent = present.join(hot, on, "left_semi").join(F.broadcast(lookup.join(hot, on, "left_semi")), on, how)
    rest = present.join(hot, on, "left_anti").join(lookup, on, how)
    out = frequent.unionByName(rest)
    if how in ("left", "left_anti"):
        out = out.unionByName(left.where(~_complete(on)), allowMissingColumns=True)
    return out


def _complete(on: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in on))


def with_labels(features: DataFrame, labels: DataFrame, key: str = "customer_ID") -> DataFrame:
    """Inner join of one-row-per-customer tables; customers without a label drop out."""
    return features.join(labels, key, "inner")


def labels_for_all(ids: DataFrame, labels: DataFrame, key: str = "customer_ID", target: str = "target") -> DataFrame:
    """Label of every id; an id without a label fails the query."""
    hit = ids.join(labels.select(key, target), key, "left")
    message = F.concat(F.lit("no label for "), F.col(key))
    checked = F.when(F.col(target).isNull(), F.raise_error(message).cast("int")).otherwise(F.col(target))
    return hit.withColumn(target, checked)


def keep_keys(df: DataFrame, keys: DataFrame, key: str = "customer_ID") -> DataFrame:
    """Rows whose key is in ``keys`` (semi-join)."""
    return lookup_join(df, keys.select(key), [key], "left_semi")


def keep_listed(df: DataFrame, ids: Sequence[str], key: str = "customer_ID") -> DataFrame:
    """Rows of a short list of keys; the list is pushed down to the scan."""
    return df.where(F.col(key).isin(list(ids)))


def drop_keys(df: DataFrame, keys: DataFrame, key: str = "customer_ID") -> DataFrame:
    """Rows whose key is not in ``keys`` (anti-join)."""
    return lookup_join(df, keys.select(key), [key], "left_anti")


def align_predictions(
    tables: dict[str, DataFrame],
    key: str = "customer_ID",
    target: str = "target",
    prediction: str = "oof_pred",
) -> DataFrame:
    """Out-of-fold tables side by side, one column per model, on a shared key.

    Every table must hold the same keys, once each, with the same label; ``misaligned``
    counts the rows that break this and ``check_aligned`` fails on them. A repeated key counts as
    unmatched.
    """
    joined: DataFrame | None = None
    for name, table in tables.items():
        # one row per key and table; the count tells when there were more
        part = table.groupBy(key).agg(
            F.first(target).alias(f"_t_{name}"), F.first(prediction).alias(name), F.count(F.lit(1)).alias(f"_n_{name}"))
        joined = part if joined is None else joined.join(part, key, "full_outer")
    return joined


def misaligned(aligned: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row: keys absent from some table, and keys whose labels disagree."""
    labels = [F.col(f"_t_{n}") for n in names]
    absent = labels[0].isNull()
    differ = F.lit(False)
    for label in labels[1:]:
        absent = absent | label.isNull()
        differ = differ | (label != labels[0])
    for n in names:
        absent = absent | (F.coalesce(f"_n_{n}", F.lit(0)) > 1)
    return aligned.agg(
        F.count("*").alias("n_keys"),
        F.count(F.when(absent, 1)).alias("n_unmatched"),
        F.count(F.when(~absent & differ, 1)).alias("n_label_conflicts"),
    )


def check_aligned(aligned: DataFrame, names: Sequence[str], key: str = "customer_ID", target: str = "target") -> DataFrame:
    """The aligned table with a single label column; fails on any misaligned row."""
    first = F.col(f"_t_{names[0]}")
    same = first.isNotNull()
    for n in names:
        same = same & (F.coalesce(f"_n_{n}", F.lit(0)) == 1)
    for n in names[1:]:
        same = same & F.col(f"_t_{n}").eqNullSafe(first)
    label = F.when(same, first).otherwise(F.raise_error(F.lit("prediction tables are not aligned")).cast("int"))
    return aligned.select(key, label.alias(target), *names)
