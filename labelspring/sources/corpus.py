"""Parquet corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_corpus(df: DataFrame, path: str, files: int | None = None, mode: str = "error") -> None:
    """Parquet sink; ``files`` fixes the number of output files.

    Without ``files`` every task writes its own partition and nothing moves.
    """
    out = df if files is None else df.repartition(files)
    out.write.mode(mode).parquet(path)


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int, mode: str = "error") -> None:
    """Save as a table bucketed and sorted on ``key``.

    Documents and labels saved this way join on ``key`` without a shuffle.
    """
    df.write.mode(mode).bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(table)
