"""Collapse each customer's statements into one row of features.

Every statistic is a mergeable aggregate, so a customer holding a large share of
all rows is reduced on the map side and never reaches one task row by row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.literals import quoted, rows_from
from ledgerline.roles import Roles

# The statistics and their name suffixes.
NUMERIC_STATS = ("mean", "std", "min", "max", "first", "last")
TREND_STATS = ("last_mean_diff", "last_first_diff", "range")
CATEGORICAL_STATS = ("last", "nunique", "count")
DATE_FEATURES = ("statement_count", "history_days")


def _numeric_aggregates(column: str) -> list[Column]:
    x = quoted(column)
    # only present values take part, so the first/last of them wins
    present = f"FILTER (WHERE {x} IS NOT NULL)"
    calls = {
        "mean": f"avg({x})", "std": f"stddev_samp({x})", "min": f"min({x})", "max": f"max({x})",
        "first": f"min_by({x}, _ord) {present}", "last": f"max_by({x}, _ord) {present}",
    }
    return [F.expr(f"{call} AS {quoted(f'{column}_{stat}')}") for stat, call in calls.items()]


def _trend(column: str) -> list[str]:
    mean, low, high, first, last = (quoted(f"{column}_{s}") for s in ("mean", "min", "max", "first", "last"))
    return [
        f"{last} - {mean} AS {quoted(f'{column}_last_mean_diff')}",
        f"{last} - {first} AS {quoted(f'{column}_last_first_diff')}",
        f"{high} - {low} AS {quoted(f'{column}_range')}",
    ]


def _date_aggregates(df: DataFrame, roles: Roles) -> list[Column]:
    day = 86_400_000_000
    micros = F.unix_micros(F.col(roles.date).cast("timestamp"))
    span = F.floor((F.max(micros) - F.min(micros)) / F.lit(day))
    return [
        F.count(roles.date).alias("statement_count"),
        span.cast("long").alias("history_days"),
    ]


def numeric_aggregates(df: DataFrame, roles: Roles, columns: Sequence[str] | None = None) -> DataFrame:
    """Mean, sample deviation, extremes and first/last present value per customer."""
    columns = list(columns if columns is not None else roles.numeric_columns(df))
    return (
        df.select(roles.key, roles.order_key(df).alias("_ord"), *columns)
        .groupBy(roles.key)
        .agg(*[a for c in columns for a in _numeric_aggregates(c)])
    )


def add_trends(aggregates: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Recent deviation, net movement and range, from aggregates already present."""
    return aggregates.selectExpr("*", *[t for c in columns for t in _trend(c)])


def categorical_aggregates(df: DataFrame, roles: Roles, columns: Sequence[str] | None = None) -> DataFrame:
    """Last present value, distinct values and present values per customer.

    Each (customer, column, value) is reduced first, with only fixed-width counters in
    the buffer: that is a hash aggregation, about twice as fast here as distinct counts
    over expanded rows, and it leaves a few rows per customer for the second step.
    """
    columns = list(columns if columns is not None else roles.categorical_columns(df))
    types = dict(df.dtypes)
    cells = ", ".join(f"named_struct('_i', {i}, '_value', CAST({quoted(c)} AS STRING))" for i, c in enumerate(columns))
    seen = (
        df.select(roles.key, roles.order_key(df).alias("_ord"), F.expr(f"inline(array({cells}))"))
        .groupBy(roles.key, "_i", "_value")
        .agg(F.count(F.lit(1)).alias("_times"), F.max("_ord").alias("_ord"))
    )
    aggs: list[Column] = []
    for i, c in enumerate(columns):
        here = f"_i = {i} AND _value IS NOT NULL"
        aggs += [
            F.expr(f"CAST(max_by(_value, _ord) FILTER (WHERE {here}) AS {types[c]}) AS {quoted(f'{c}_last')}"),
            F.expr(f"count_if({here}) AS {quoted(f'{c}_nunique')}"),
            F.expr(f"coalesce(sum(CASE WHEN {here} THEN _times END), 0L) AS {quoted(f'{c}_count')}"),
        ]
    return seen.groupBy(roles.key).agg(*aggs)


def date_features(df: DataFrame, roles: Roles) -> DataFrame:
    """Dated statements per customer and whole days between the first and last one."""
    return df.groupBy(roles.key).agg(*_date_aggregates(df, roles))


def gather_customers(df: DataFrame, roles: Roles) -> DataFrame:
    """Bring each customer's rows together ahead of a wide aggregation.

    An aggregation buffer is about as wide as a customer's whole history. Where the
    rows of a customer lie scattered over many files (say, one per month), partial
    aggregation would ship one buffer per row; moving the rows first is far cheaper.
    Rebalancing lets adaptive execution split the partition of a huge customer.
    """
    return df.hint("rebalance", F.col(roles.key))


def aggregated(rows: DataFrame, roles: Roles, numeric: Sequence[str]) -> DataFrame:
    """Numeric, trend and date features in one aggregation of rows with their order key ``_ord``."""
    aggs = [a for c in numeric for a in _numeric_aggregates(c)] + _date_aggregates(rows, roles)
    return add_trends(rows.groupBy(roles.key).agg(*aggs), numeric)


def customer_features(df: DataFrame, roles: Roles, scattered: bool = False) -> DataFrame:
    """All features: numeric, trend, categorical (raw last value) and date-derived.

    Set ``scattered`` when a customer's statements are not stored next to each other.

    Numeric and date statistics share one aggregation. The categorical block turns
    every statement into one row per column, so it reads its own few columns.
    Both blocks leave the data hash-partitioned by customer: their join adds no
    further shuffle.
    """
    numeric = roles.numeric_columns(df)
    categorical = roles.categorical_columns(df)
    # a statement without a customer belongs to nobody, in both blocks
    df = df.where(F.col(roles.key).isNotNull())
    rows = df.select(roles.key, roles.date, roles.order_key(df).alias("_ord"), *numeric)
    wide = aggregated(gather_customers(rows, roles) if scattered else rows, roles, numeric)
    if categorical:
        # both sides have the same customers, one row each; a left join on the unique key
        # goes from the plan when no categorical feature is used
        wide = wide.join(categorical_aggregates(df, roles, categorical), roles.key, "left")
    return wide.select(roles.key, *feature_names(numeric, categorical))


def feature_names(numeric: Sequence[str], categorical: Sequence[str]) -> list[str]:
    """Feature columns in table order. Consumers go by name, not by position."""
    names = [f"{c}_{s}" for c in numeric for s in (*NUMERIC_STATS, *TREND_STATS)]
    names += [f"{c}_{s}" for c in categorical for s in CATEGORICAL_STATS]
    return names + list(DATE_FEATURES)


def to_float_sink(features: DataFrame, keep: Sequence[str]) -> DataFrame:
    """32-bit floats for everything but ``keep``: applied where the table is written."""
    return features.select(
        *[F.col(c) if c in keep or t == "string" else F.col(c).cast("float").alias(c) for c, t in features.dtypes]
    )


def align_columns(features: DataFrame, names: Sequence[str], key: str, types: dict[str, str] | None = None) -> DataFrame:
    """Project to the trained column list: absent columns become NULL, extras go."""
    have = set(features.columns)
    types = types or {}
    return features.select(
        key,
        *[F.col(n) if n in have else F.lit(None).cast(types.get(n, "float")).alias(n) for n in names],
    )


def missing_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing: replaced by NULL once, at ingest."""
    floats = {c for c, t in df.dtypes if t in ("float", "double")}
    return df.select(*[F.nanvl(F.col(c), F.lit(None).cast(t)).alias(c) if c in floats else F.col(c) for c, t in df.dtypes])


def mark_latest(df: DataFrame, roles: Roles, flag: str = "is_latest") -> DataFrame:
    """Flag each customer's latest statement, keeping all rows.

    The latest position is a mergeable maximum per customer. It is joined back on
    (customer, date, tie), so the rows of one huge customer stay spread out. Without a
    tie column a hash of the whole row decides between equal dates; rows equal in every column
    cannot be told apart and are flagged together.
    """
    order = roles.order_columns()
    if not roles.tie:
        marked = df.withColumn("_row", F.xxhash64(*df.columns))
        return mark_latest(marked, replace(roles, tie="_row"), flag).drop("_row")
    latest = (
        df.groupBy(roles.key)
        .agg(F.max(F.struct(*order)).alias("_latest"))
        .select(roles.key, *[F.col(f"_latest.{c}").alias(c) for c in order], F.lit(True).alias(flag))
    )
    return df.join(latest, [roles.key, *order], "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def override_latest(df: DataFrame, roles: Roles, values: dict[str, float]) -> DataFrame:
    """What-if input: the given columns replaced on each customer's latest statement."""
    marked = mark_latest(df, roles, "_is_latest")
    replaced = [
        F.when(F.col("_is_latest"), F.lit(values[c]).cast(t)).otherwise(F.col(c)).alias(c) if c in values else F.col(c)
        for c, t in df.dtypes
    ]
    return marked.select(*replaced)


def skew_check(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str], tolerance: float = 1e-3) -> DataFrame:
    """Compare two feature tables column by column: one row per feature.

    The wide rows are joined once by customer and reduced in a single aggregation,
    so no (customer, feature) pair is ever shuffled. Customers found on one side
    only count as a mismatch of every feature. Texts differ by 1 or by 0. ``same_place`` tells whether the
    column stands at the same position in both tables: a model fed by position would read it wrongly otherwise.
    """
    places = [{c: i for i, c in enumerate(c for c in df.columns if c != key)} for df in (left, right)]
    moved = [c for c in columns if places[0][c] != places[1][c]]
    types = dict(left.dtypes)
    both = left.select(key, *columns, F.lit(1).alias("_l")).alias("l").join(
        right.select(key, *columns, F.lit(1).alias("_r")).alias("r"), key, "full_outer"
    )
    aggs = []
    for i, c in enumerate(columns):
        a, b = f"l.{quoted(c)}", f"r.{quoted(c)}"
        differ = f"_l IS NULL OR _r IS NULL OR ({a} IS NULL) <> ({b} IS NULL)"
        aggs.append(F.expr(f"count_if({differ}) AS n{i}"))
        apart = f"CAST({a} <> {b} AS DOUBLE)" if types[c] == "string" else f"abs(CAST({a} AS DOUBLE) - CAST({b} AS DOUBLE))"
        aggs.append(F.expr(f"max({apart}) AS d{i}"))
    ok = (F.col("null_mismatches") == 0) & (F.coalesce("max_abs_diff", F.lit(0.0)) < tolerance)
    return both.agg(*aggs).select(
        rows_from(columns, {"null_mismatches": "n", "max_abs_diff": "d"})
    ).withColumn("same_place", ~F.col("feature").isin(moved)).withColumn("matches", ok & F.col("same_place"))

