"""Profiling of statement tables and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions.literals import quoted, rows_from
from ledgerline.operators.joins import lookup_join
from ledgerline.operators.ordered import exact_quantiles
from ledgerline.roles import Roles
from ledgerline.session import materialize

# Missing-rate buckets (upper edge inclusive) and column groups.
MISSING_BUCKETS = ((0.0, "0%"), (0.1, "0-10%"), (0.3, "10-30%"), (0.5, "30-50%"), (0.9, "50-90%"), (1.01, ">90%"))
GROUP_NAMES = {"B": "Balance", "D": "Delinquency", "P": "Payment", "R": "Risk", "S": "Spend"}


def sample_head(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first ``n`` rows in a stated order."""
    return df.orderBy(*order).limit(n)


def seeded_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, the same ones for the same seed and keys."""
    drawn = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    return df.orderBy(drawn, key).limit(n)


def missing_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of missing values per column, in one pass."""
    aggs = [F.expr(f"avg(CAST({quoted(c)} IS NULL AS DOUBLE)) AS r{i}") for i, c in enumerate(columns)]
    return df.agg(*aggs).select(rows_from(columns, {"missing_rate": "r"}))


def missing_bucket(rate: Column) -> Column:
    out = F.when(rate <= MISSING_BUCKETS[0][0], MISSING_BUCKETS[0][1])
    for edge, name in MISSING_BUCKETS[1:]:
        out = out.when(rate <= edge, name)
    return out


def missing_buckets(rates: DataFrame) -> DataFrame:
    """Number of columns per missing-rate bucket."""
    return rates.groupBy(missing_bucket(F.col("missing_rate")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("features")
    )


def top_missing(rates: DataFrame, k: int = 10) -> DataFrame:
    return rates.orderBy(F.desc("missing_rate"), "feature").limit(k)


def mostly_missing(rates: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Number of columns missing in more than ``threshold`` of the rows."""
    return rates.agg(F.count(F.when(F.col("missing_rate") > threshold, 1)).alias("n_high"))


def feature_groups(spark: SparkSession, columns: Sequence[str]) -> DataFrame:
    """Columns per name prefix."""
    names = spark.createDataFrame([(c,) for c in columns], "feature string")
    prefix = F.split("feature", "_")[0]
    known = F.create_map(*[F.lit(x) for kv in GROUP_NAMES.items() for x in kv])
    return (
        names.groupBy(prefix.alias("prefix"))
        .agg(F.count(F.lit(1)).alias("features"))
        .withColumn("group_name", F.coalesce(known[F.col("prefix")], F.col("prefix")))
    )


def profile_table(df: DataFrame, roles: Roles) -> DataFrame:
    """Shape, distinct customers and date range.

    Distinct customers are counted by grouping first, so no task holds them all.
    """
    per_customer = df.groupBy(roles.key).agg(
        F.count(F.lit(1)).alias("n"), F.min(roles.date).alias("a"), F.max(roles.date).alias("b")
    )
    return per_customer.agg(
        F.sum("n").alias("n_rows"),
        F.lit(len(df.columns)).cast("int").alias("n_columns"),
        F.lit(len(roles.feature_columns(df))).cast("int").alias("n_features"),
        F.count(roles.key).alias("n_customers"),
        F.min("a").alias("first_date"),
        F.max("b").alias("last_date"),
    )


def dtype_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns per data type, from the schema alone."""
    types = dict(df.dtypes)
    rows = [(types[c],) for c in columns]
    return df.sparkSession.createDataFrame(rows, "dtype string").groupBy("dtype").agg(
        F.count(F.lit(1)).alias("columns")
    )


def profile_categoricals(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct present values and missing share of each categorical column."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns])
    counts = df.select(F.inline(cells)).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("feature").agg(
        F.count("value").alias("cardinality"),
        (F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)) / F.sum("n")).alias("missing_rate"),
    )


def statements_per_customer(df: DataFrame, key: str) -> DataFrame:
    """How many customers have how many statements."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("statements"))
    return sizes.groupBy("statements").agg(F.count(F.lit(1)).alias("customers"))


def describe(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles of a column."""
    x = F.col(column).cast("double")
    moments = df.agg(
        F.count(x).alias("count"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
    )
    # one row of quartiles
    found = exact_quantiles(df, column, [0.25, 0.5, 0.75]).first()
    q = [F.lit(float(v)) for v in found["q"]] if found else [F.lit(None).cast("double")] * 3
    return moments.select(
        "count", "mean", "std", "min", q[0].alias("q25"), q[1].alias("q50"), q[2].alias("q75"), "max"
    )


def customer_dates(df: DataFrame, roles: Roles) -> DataFrame:
    """Last statement date per customer."""
    return df.groupBy(roles.key).agg(F.max(roles.date).alias("last_date"))


def month_histogram(dates: DataFrame, column: str = "last_date") -> DataFrame:
    return dates.groupBy(F.date_format(column, "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("customers"))


def target_distribution(labels: DataFrame, target: str = "target") -> DataFrame:
    """Customers and share per class, with the overall default rate."""
    counts = labels.groupBy(target).agg(F.count(F.lit(1)).alias("customers"))
    # one row per class
    whole = Window.partitionBy()
    total = F.sum("customers").over(whole)
    return counts.select(
        target,
        "customers",
        (F.col("customers") / total).alias("share"),
        (F.sum(F.col("customers") * F.col(target)).over(whole) / total).alias("default_rate"),
    )


def density_histogram(df: DataFrame, column: str, by: str, bins: int = 50) -> DataFrame:
    """Equal-width density histogram of a column, per class or split.

    Each class has its own range, as when every class is drawn on its own; the last
    bin is closed. A class without spread is drawn one unit wide around its value.
    """
    present = df.select(by, F.col(column).cast("double").alias("_x")).where("_x IS NOT NULL AND NOT isnan(_x)")
    low, high = F.min("_x"), F.max("_x")
    flat = low == high
    # one row per class
    ranges = present.groupBy(by).agg(
        F.when(flat, low - 0.5).otherwise(low).alias("_lo"),
        (F.when(flat, F.lit(1.0)).otherwise(high - low) / bins).alias("_w"),
        F.count(F.lit(1)).alias("_n"),
    )
    placed = lookup_join(present, materialize(ranges, "ranges"), [by], "left")
    bin_ = F.least(F.floor((F.col("_x") - F.col("_lo")) / F.col("_w")), F.lit(bins - 1)).cast("int")
    return (
        placed.groupBy(by, bin_.alias("bin"), "_lo", "_w", "_n")
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(
            by,
            "bin",
            (F.col("_lo") + F.col("bin") * F.col("_w")).alias("left_edge"),
            "rows",
            (F.col("rows") / (F.col("_n") * F.col("_w"))).alias("density"),
        )
    )


def last_value_by_target(df: DataFrame, labels: DataFrame, roles: Roles, column: str) -> DataFrame:
    """Last present value of a column per labelled customer."""
    x = F.col(column)
    last = (
        df.withColumn("_ord", roles.order_key(df))
        .groupBy(roles.key)
        .agg(F.max_by(x, F.when(x.isNotNull(), F.col("_ord"))).alias(f"{column}_last"))
    )
    return last.join(labels, roles.key)


def trajectory(df: DataFrame, roles: Roles, column: str) -> DataFrame:
    """A column along each customer's statements, by month."""
    return df.select(
        roles.key, *roles.order_columns()[1:], F.date_format(roles.date, "yyyy-MM").alias("month"), column
    )
