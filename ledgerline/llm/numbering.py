"""Gapless numbers inside groups, however many rows one group holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.stages import partitions


def numbered(df: DataFrame, group: str, order: Sequence[Column], name: str) -> DataFrame:
    """Adds ``name``: 0, 1, 2, ... inside each value of ``group``.

    A group is cut into cells by a hash of the order columns, about four cells per
    shuffle partition over the whole table, so a group with a third of all rows is
    numbered by many tasks. Cell counts give every cell its first number. ``df`` must
    be a stored table: it is read three times. Rows equal in ``order`` get numbers in no
    fixed order among themselves.
    """
    share = F.sum("_n").over(Window.partitionBy(F.lit(0)))
    spread = 4 * partitions(df.sparkSession)
    # one row per group here, never one per row of the table
    cells = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).withColumn("_all", share)
    cells = cells.select(group, F.ceil(F.col("_n") * spread / F.col("_all")).cast("int").alias("_cells"))
    hashed = df.join(F.broadcast(cells), group).withColumn("_cell", F.pmod(F.xxhash64(*order), F.col("_cells")))
    hashed = hashed.drop("_cells")
    before = Window.partitionBy(group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    firsts = hashed.groupBy(group, "_cell").agg(F.count(F.lit(1)).alias("_n")).select(
        group, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first")
    )
    inside = Window.partitionBy(group, "_cell").orderBy(*order)
    rows = hashed.withColumn("_at", F.row_number().over(inside) - 1)
    joined = rows.join(F.broadcast(firsts), [group, "_cell"])
    return joined.withColumn(name, (F.col("_first") + F.col("_at")).cast("long")).drop("_first", "_at", "_cell")
