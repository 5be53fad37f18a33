"""Exact ranks inside groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelspring.runtime import durable


def rank_within(
    df: DataFrame, group: str, order: Sequence[Column], name: str = "ind"
) -> DataFrame:
    """0-based row number inside each group, exact even for one dominant group.

    A window partitioned by the group alone would sort a hot group in a single
    task.  Rows are range-partitioned on (group, order) instead, so a hot group
    covers many partitions; each partition ranks its own slice, and the slice
    sizes, at most one row per partition and group, give the offsets.  The
    ranged rows are written out once so that both uses see the same slices.
    """
    ranged = (
        df.repartitionByRange(F.col(group), *order)
        .withColumn("_slice", F.spark_partition_id())
    )
    ranged = durable(ranged, "ranged")
    slices = ranged.groupBy(group, "_slice").agg(F.count("*").alias("_rows"))
    before = (
        Window.partitionBy(group)
        .orderBy("_slice")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    offsets = slices.select(
        group, "_slice", (F.sum("_rows").over(before) - F.col("_rows")).alias("_offset")
    )
    local = Window.partitionBy("_slice", group).orderBy(*order)
    return (
        ranged.withColumn("_local", F.row_number().over(local) - 1)
        .join(offsets, [group, "_slice"])
        .withColumn(name, (F.col("_offset") + F.col("_local")).cast("bigint"))
        .drop("_slice", "_local", "_offset")
    )
