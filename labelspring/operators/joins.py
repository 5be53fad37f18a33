"""Joins that stay spread out when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT = 1000  # a key with more than one of this many rows is hot, so at most this many keys are


def join_groups(rows: DataFrame, groups: DataFrame, on: Sequence[str], members: str | None = None) -> DataFrame:
    """Inner join of ``rows`` with ``groups``, which has at most one row for each key.

    Hot keys, at most HOT by their definition, are joined by a broadcast, so their rows stay
    where they are; the others by a shuffle.  ``members`` names a column of ``groups`` with
    the number of ``rows`` of its key; without it they are counted here, pre-aggregated.
    Both inputs should be written tables, since they are read twice.
    """
    on = list(on)
    total = rows.count()
    if members is None:
        counts = rows.groupBy(*on).agg(F.count("*").alias("_members")).where(F.col("_members") * HOT > total)
        hot = groups.join(F.broadcast(counts.select(*on)), on, "left_semi")
    else:
        hot = groups.where(F.col(members) * HOT > total)
    hot = F.broadcast(hot)
    cold_rows = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return cold_rows.join(groups, on).unionByName(rows.join(hot, on))
