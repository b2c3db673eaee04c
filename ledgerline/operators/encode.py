"""Category dictionaries: fitted on training data, applied everywhere else.

A dictionary is a small table ``col, value, code``. Values are text; codes count up
from 0 in the native order of the column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNSEEN = -1
EXACT = 2.0**53
DICTIONARY_SCHEMA = "col string, value string, code int"


def value_text(df: DataFrame, column: str) -> Column:
    """Text form of a category: a whole number reads the same as integer, decimal and float.

    From 2^53 on, where neighbours share a double, it is the exact integer.
    """
    kind, value = df.schema[column].dataType, F.col(column)
    if not isinstance(kind, T.NumericType):
        return value.cast("string")
    plain = (value.cast("double") if isinstance(kind, (T.IntegralType, T.DecimalType)) else value).cast("string")
    if isinstance(kind, T.DecimalType):
        plain = F.when(_large(value), value.cast("string")).otherwise(plain)
    return F.coalesce(_large_whole(value, kind).cast("string"), plain)


def _large(value: Column) -> Column:
    return F.abs(value.cast("double")) >= EXACT


def _large_whole(value: Column, kind: T.DataType) -> Column:
    """A whole number of 2^53 or more as BIGINT, where it fits; else NULL."""
    if isinstance(kind, T.IntegralType):
        return F.when(_large(value), value.cast("long"))
    if not isinstance(kind, T.NumericType):
        return F.lit(None).cast("long")
    whole = F.when(_large(value), value).try_cast("long")
    return F.when(whole == value, whole) if isinstance(kind, T.DecimalType) else whole


def fit_dictionary(df: DataFrame, columns: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """Distinct present values of each column, ranked natively (numbers as numbers)."""
    names = list(names or columns)
    types = dict(df.dtypes)
    entries = [
        F.struct(
            F.lit(name).alias("col"),
            value_text(df, c).alias("value"),
            (F.lit(None) if types[c] == "string" else F.col(c)).cast("double").alias("_number"),
            _large_whole(F.col(c), df.schema[c].dataType).alias("_whole"),
        )
        for c, name in zip(columns, names)
    ]
    seen = df.select(F.inline(F.array(*entries))).where(F.col("value").isNotNull()).distinct()
    native = Window.partitionBy("col").orderBy("_number", "_whole", "value")
    return seen.select("col", "value", (F.row_number().over(native) - 1).cast("int").alias("code"))


def fit_last_dictionary(features: DataFrame, categoricals: Sequence[str]) -> DataFrame:
    """Dictionary of the categorical columns, from their last value per customer."""
    return fit_dictionary(features, [f"{c}_last" for c in categoricals], categoricals)


def apply_dictionary(
    df: DataFrame, dictionary: DataFrame, columns: Sequence[str], names: Sequence[str] | None = None
) -> DataFrame:
    """Replace values by their codes. NULL and values unseen in training become -1.

    Keep ``dictionary`` as a stored table: Spark then knows its bytes and broadcasts it or not. No job runs here.
    """
    names = list(names or columns)
    order = df.columns
    out = df
    for c, name in zip(columns, names):
        codes = dictionary.where(F.col("col") == name).select(
            F.col("value").alias("_value"), F.col("code").alias("_code")
        )
        out = out.withColumn("_value", value_text(out, c)).join(codes, "_value", "left")
        out = out.withColumn(c, F.coalesce("_code", F.lit(UNSEEN)).cast("int")).drop("_value", "_code")
    return out.select(*order)


def encode_last(features: DataFrame, dictionary: DataFrame, categoricals: Sequence[str]) -> DataFrame:
    """Encode the ``<column>_last`` features with a fitted dictionary."""
    return apply_dictionary(features, dictionary, [f"{c}_last" for c in categoricals], categoricals)


def dictionary_as_lists(dictionary: DataFrame) -> dict[str, list[str]]:
    """``{column: [values in code order]}``, the exchange form of a fitted dictionary."""
    slots = F.array_sort(F.collect_list(F.struct("code", "value")))
    rows = dictionary.groupBy("col").agg(F.transform(slots, lambda s: s["value"]).alias("v")).collect()
    return {r["col"]: list(r["v"]) for r in rows}
