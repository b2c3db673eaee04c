"""CSV to Parquet ingest with a schema taken from the header, and table sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.operators.features import missing_to_null
from ledgerline.roles import TEXT_COLUMNS, Roles
from ledgerline.session import scratch_path


def schema_for(columns: Sequence[str], roles: Roles = Roles(), text: Sequence[str] = TEXT_COLUMNS) -> T.StructType:
    """Key and text columns as strings, the date as a timestamp, everything else as float."""
    def type_of(c: str) -> T.DataType:
        if c == roles.key or c in text:
            return T.StringType()
        return T.TimestampNTZType() if c == roles.date else T.FloatType()

    return T.StructType([T.StructField(c, type_of(c)) for c in columns])


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names from the first line; no data is read and no type is guessed."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path).columns


def read_csv(spark: SparkSession, path: str, roles: Roles = Roles()) -> DataFrame:
    """Typed read in file column order; a malformed cell fails the job. NaN becomes NULL."""
    schema = schema_for(csv_header(spark, path), roles)
    frame = (
        spark.read.schema(schema).option("header", True).option("enforceSchema", False)
        .option("mode", "FAILFAST").option("nanValue", "NaN").csv(path)
    )
    return missing_to_null(frame)


def csv_to_parquet(spark: SparkSession, csv_path: str, parquet_path: str, roles: Roles = Roles(), mode: str = "errorifexists") -> None:
    """One distributed job: column order kept, snappy files."""
    write_parquet(read_csv(spark, csv_path, roles), parquet_path, mode)


def convert_splits(spark: SparkSession, paths: dict[str, tuple[str, str]], roles: Roles = Roles(), mode: str = "errorifexists") -> None:
    """Convert the named splits, train first whatever the order given.

    The later splits must have the columns of train, in its order: what is fitted on train is applied to them.
    """
    if "train" not in paths:
        raise ValueError("no split named train")
    names = ["train", *(n for n in paths if n != "train")]
    headers = {n: csv_header(spark, paths[n][0]) for n in names}
    other = [n for n in names if headers[n] != headers["train"]]
    if other:
        raise ValueError(f"columns differ from those of train: {', '.join(other)}")
    for name in names:
        csv_to_parquet(spark, *paths[name], roles, mode)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("compression", "snappy").parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Side tables: dictionaries, statistics, knots, metadata, metrics."""
    df.write.mode(mode).json(path)


def read_json(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def report_lines(report: DataFrame) -> str:
    """A (metric, value) report as a Markdown table. One row per metric."""
    rows = report.orderBy("metric").collect()
    body = "\n".join(f"| {r['metric']} | {r['value']:.5f} |" for r in rows if r["value"] is not None)
    return f"| metric | value |\n|---|---|\n{body}\n"


def report_document(report: DataFrame) -> str:
    """A full report (section, item, metric, value) as one Markdown table per section: items down, metrics across.

    The report is small whatever its input: bands, bins and approval rates.
    """
    sections: dict[str, dict[float | None, dict[str, float]]] = {}
    for r in report.orderBy("section", "item", "metric").collect():
        sections.setdefault(r["section"], {}).setdefault(r["item"], {})[r["metric"]] = r["value"]
    out = []
    for name, items in sections.items():
        metrics = sorted({m for values in items.values() for m in values})
        out += [f"## {name}", "", "| item | " + " | ".join(metrics) + " |", "|---" * (len(metrics) + 1) + "|"]
        for item, values in items.items():
            cells = ["" if values.get(m) is None else f"{values[m]:.5f}" for m in metrics]
            out.append(f"| {'' if item is None else f'{item:g}'} | " + " | ".join(cells) + " |")
        out.append("")
    return "\n".join(out)


def roundtrip_csv(source: DataFrame, roles: Roles) -> DataFrame:
    """Write a statement table as CSV, ingest it to Parquet, read the result."""
    spark = source.sparkSession
    csv_path, parquet_path = scratch_path(spark, "csv"), scratch_path(spark, "ingested")
    write_csv(source.withColumn(roles.date, F.date_format(roles.date, "yyyy-MM-dd")), csv_path)
    csv_to_parquet(spark, csv_path, parquet_path, roles)
    return spark.read.parquet(parquet_path)
