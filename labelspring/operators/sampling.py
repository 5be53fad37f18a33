"""Exact random samples of a given number of rows, for many sizes and trials at once.

Every trial orders the rows by a hash of (id, seed, trial), then by id; a sample of n rows
is the first n.  Samples of one trial are nested, and a row knows its samples by comparing
itself with their last rows, so nothing but those last rows has to be found.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelspring.functions import sql
from labelspring.operators.splits import hash32
from labelspring.runtime import durable

COARSE = 16  # leading bits of the hash that are counted first


@dataclass(frozen=True)
class Draw:
    """A sample and its last row; ``last_hash`` is None where the sample holds all rows."""

    run: int
    size: int
    trial: int
    last_hash: int | None
    last_id: object


def nth_least(df: DataFrame, id_col: str, sizes: Sequence[int], trials: Sequence[int], seed: int) -> DataFrame:
    """``(trial, size, hash, id)`` of the size-th row of each trial's order.

    Two passes, neither of which sorts the rows: the counts of the hash's leading bits, at
    most 65,536 a trial, tell which of those cells holds the wanted row; only the
    rows of that cell are then ranked.  Sizes beyond the number of rows give no row.
    """
    spark = df.sparkSession
    hashes = F.array(*[
        F.struct(F.lit(int(t)).alias("trial"), hash32(F.col(id_col), F.lit(seed), F.lit(int(t))).alias("hash")) for t in trials
    ])
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.explode(hashes).alias("_h")).select("id", "_h.*")
    rows = rows.withColumn("cell", F.shiftright("hash", 32 - COARSE))
    counts = rows.groupBy("trial", "cell").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("trial").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = counts.withColumn("upto", F.sum("n").over(upto))
    wanted = spark.createDataFrame([(int(t), int(s)) for t in trials for s in sizes], "trial int, size bigint")
    found = cells.join(wanted, "trial").where((F.col("size") <= F.col("upto")) & (F.col("size") > F.col("upto") - F.col("n")))
    # one row for each (trial, size)
    found = durable(found.select("trial", "size", "cell", (F.col("size") - F.col("upto") + F.col("n")).alias("place")), "cells")
    inside = rows.join(F.broadcast(found.select("trial", "cell").distinct()), ["trial", "cell"], "left_semi")
    place = F.row_number().over(Window.partitionBy("trial", "cell").orderBy("hash", "id"))
    return inside.withColumn("place", place).join(F.broadcast(found), ["trial", "cell", "place"]).select("trial", "size", "hash", "id")


def draws(df: DataFrame, id_col: str, sizes: Sequence[int], trials: int, seed: int) -> list[Draw]:
    """One draw for each (size, trial), in that order."""
    numbers = range(1, trials + 1)
    last = {(r["size"], r["trial"]): (r["hash"], r["id"]) for r in nth_least(df, id_col, sizes, numbers, seed).collect()}
    return [
        Draw(run, n, t, *last.get((n, t), (None, None))) for run, (n, t) in enumerate((n, t) for n in sizes for t in numbers)
    ]


def drawn_runs(chosen: Sequence[Draw], id_col: str, seed: int) -> Column:
    """The runs whose sample holds the row; an expression of its id alone."""
    trials = sorted({d.trial for d in chosen})
    place = {t: i for i, t in enumerate(trials)}
    key = sql.name(id_col)
    hashes = ", ".join(
        f"CAST(conv(substring(md5(concat_ws(':', {key}, {int(seed)}, {t})), 1, 8), 16, 10) AS BIGINT)" for t in trials
    )
    tests = ", ".join(
        f"named_struct('run', {d.run}, 'in', "
        + (
            f"{key} IS NOT NULL" if d.last_hash is None
            else f"(h[{place[d.trial]}] < {d.last_hash} OR (h[{place[d.trial]}] = {d.last_hash} AND {key} <= {sql.literal(d.last_id)}))"
        )
        + ")"
        for d in chosen
    )
    mine = f"transform(filter(array({tests}), w -> w.in), w -> w.run)"
    return F.expr(sql.bind("h", f"array({hashes})", mine))
