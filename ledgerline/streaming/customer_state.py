"""Features of a stream of statements, carried from batch to batch.

A customer's statements may come over many batches. Every statistic is one of Spark's mergeable aggregates, kept in the
stream's state as a fixed number of values per numeric column, however long the history. Tasks reduce a batch's rows to one
state per customer before the shuffle, so a customer with a large share of a batch sends a few rows; merging does not depend on
the order of arrival, since first and last go with their order keys. No Python runs per customer.

Numeric, trend and date features; a categorical feature needs its values and is not carried. NULL keys belong to nobody. NULL
and NaN are missing. Every batch gives the rows of the customers it touched; ``latest_rows`` keeps the newest of each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.literals import quoted
from ledgerline.operators.features import aggregated, feature_names, missing_to_null
from ledgerline.roles import Roles


def running_features(stream: DataFrame, roles: Roles, numeric: Sequence[str] | None = None) -> DataFrame:
    """Features of the customers a batch touches, over all their statements so far."""
    numeric = list(numeric if numeric is not None else roles.numeric_columns(stream))
    known = stream.where(F.col(roles.key).isNotNull())
    rows = known.select(roles.key, roles.date, roles.order_key(known).alias("_ord"), *[F.col(quoted(c)).cast("double").alias(c) for c in numeric])
    return aggregated(missing_to_null(rows), roles, numeric).select(roles.key, *feature_names(numeric, []))


def latest_rows(log: DataFrame, key: str, batch: str = "batch") -> DataFrame:
    """The newest logged row of each customer, from a log whose batches own a folder each."""
    columns = [c for c in log.columns if c not in (key, batch)]
    newest = log.groupBy(key).agg(F.max_by(F.struct(*columns), batch).alias("_row"))
    return newest.select(key, *[F.col(f"_row.{c}").alias(c) for c in columns])
