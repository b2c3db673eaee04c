"""Statement rows as JSON: required id and date, any number of extra numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.roles import Roles
from ledgerline.sources.ingest import schema_for

PROPS_SCHEMA = "k double"


def request_schema(features: Sequence[str], roles: Roles = Roles()) -> T.StructType:
    """Schema of a request row; fields absent from a row are NULL, unknown ones are ignored."""
    schema = schema_for([roles.key, roles.date, *features], roles)
    schema[roles.date].dataType = T.StringType()
    return schema


def read_statements(spark: SparkSession, path: str, features: Sequence[str], roles: Roles = Roles()) -> DataFrame:
    rows = spark.read.schema(request_schema(features, roles)).json(path)
    return check_required(rows, roles)


def parse_statements(df: DataFrame, column: str, features: Sequence[str], roles: Roles = Roles()) -> DataFrame:
    """Request bodies held in a text column, each an array of statements."""
    schema = T.ArrayType(request_schema(features, roles))
    rows = df.select(F.inline(F.from_json(column, schema)))
    return check_required(rows, roles)


def check_required(rows: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Parse the date; a row without id or with a bad date fails the query."""
    def needed(value: Column, name: str, dtype: str) -> Column:
        return F.when(value.isNotNull(), value).otherwise(
            F.raise_error(F.lit(f"statement without a valid {name}")).cast(dtype)
        )

    date = F.coalesce(
        F.try_to_timestamp(F.col(roles.date)).cast("timestamp_ntz"), F.lit(None).cast("timestamp_ntz")
    )
    return rows.select(
        needed(F.col(roles.key), roles.key, "string").alias(roles.key),
        needed(date, roles.date, "timestamp_ntz").alias(roles.date),
        *[c for c in rows.columns if c not in (roles.key, roles.date)],
    )


def parse_events(events: DataFrame) -> DataFrame:
    """The event table's JSON properties as typed columns next to id and date."""
    props = F.from_json("props", PROPS_SCHEMA)
    return events.select(
        F.col("user_id").cast("string").alias("customer_ID"),
        F.col("event_id"),
        F.date_trunc("day", "ts").cast("timestamp_ntz").alias("S_2"),
        props["k"].alias("k"),
        F.to_json(F.struct(F.col("event_type").alias("type"), props["k"].cast("long").alias("k"))).alias("response"),
    )
