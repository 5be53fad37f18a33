"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelspring.runtime import scratch_path

BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = str(8 << 20)

A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(docs: DataFrame, hashed: bool = False) -> DataFrame:
    """``doc_id`` (long) and ``text`` only; a null text counts as empty.  ``hashed`` adds ``text_hash``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    more = [F.xxhash64(text).alias("text_hash")] if hashed else []
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *more)


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: no lineage, exact size, safe from lost executors."""
    path = scratch_path(df.sparkSession, name)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    with small_batches(df.sparkSession):
        writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession):
    """Batches of at most BATCH_BYTES to and from Python for the jobs inside.

    Spark holds a few of them for every task, outside its heap, and the worker as many.
    """
    before = spark.conf.get(BATCH_SETTING, None)
    spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_SETTING)
        else:
            spark.conf.set(BATCH_SETTING, before)


_kept: dict[str, Callable[[], None]] = {}


def keeps(owner: str, forget: Callable[[], None]) -> None:
    """Tell that worker processes keep something for ``owner``, and how to drop it."""
    _kept[owner] = forget


def forget_others(owner: str) -> None:
    """Drop, in this worker, what is kept for others."""
    for name, forget in _kept.items():
        if name != owner:
            forget()


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], owner: str = ""):
    """The Arrow function ``run``, whose worker first drops what it keeps for others than ``owner``.

    Workers serve one stage after the other, and so would hold the memories of all of them.
    At the end freed buffers go back to the system.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(owner)
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return wrapped


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, A_TO_Z, A_TO_Z.lower())


def without(docs: DataFrame, gone: DataFrame, again: DataFrame | None = None) -> DataFrame:
    """``docs`` without the rows named in ``gone``, and with rows repeated in ``again`` once.

    Both are written tables of doc_id and text_hash, so null ids and ids used twice
    are told apart, and the planner broadcasts them only if they are small.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marked = docs.withColumns({"_row_id": F.col("doc_id").cast("long"), "_row_hash": F.xxhash64(text)})

    def matches(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
        named = ids.select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_hash")).distinct()
        same = F.col("_row_id").eqNullSafe(F.col("_gone_id")) & (F.col("_row_hash") == F.col("_gone_hash"))
        return rows.join(named, same, how)

    rest = matches(marked, gone, "left_anti")
    if again is not None and not again.isEmpty():
        once = matches(rest, again, "left_semi").dropDuplicates(["_row_id", "_row_hash"])
        rest = matches(rest, again, "left_anti").unionByName(once)
    return rest.drop("_row_id", "_row_hash")
