"""Helpers shared by the corpus operators: stored stages and Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.session import materialize, scratch_path

__all__ = ["BATCH_ROWS", "arrow", "materialize", "partitions", "scratch_path", "small_batches", "table", "text_bytes", "texts_of"]


# rows handled at a time where texts are returned: the copies made on the way stay small
SLICE = 500
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of up to ``rows`` for what runs inside: large rows are held several times, by the executor and by Python."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def arrow(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.Table | pa.RecordBatch | None], schema: str, rows: int | None = None
) -> DataFrame:
    """``fn`` over every Arrow batch of ``df``, cut into slices of ``rows`` if given; None adds no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, rows or max(1, batch.num_rows)):
                out = fn(batch.slice(low, rows) if rows else batch)
                if isinstance(out, pa.Table):
                    yield from out.to_batches()
                elif out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; NULL is empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def text_bytes(column: str = "text"):
    """Size of a text in UTF-8 bytes; NULL has none."""
    return F.coalesce(F.octet_length(column), F.lit(0)).cast("long")
