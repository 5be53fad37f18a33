"""Folders of the shared store: small records, listings, removal."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, store = _file_system(spark, path)
    return store.exists(place)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder, sorted; none if it is missing."""
    place, store = _file_system(spark, path)
    if not store.exists(place):
        return []
    return sorted(entry.getPath().getName() for entry in store.listStatus(place))


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder with all it holds; no error if it is missing."""
    place, store = _file_system(spark, path)
    store.delete(place, True)


def write_record(spark: SparkSession, path: str, record: dict) -> None:
    """A JSON record as a folder of one line, committed by Spark's own marker file."""
    spark.createDataFrame([(json.dumps(record, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_record(spark: SparkSession, path: str) -> dict | None:
    """The record, or None where it was never committed."""
    if not exists(spark, f"{path}/_SUCCESS"):
        return None
    return json.loads(spark.read.text(path).first()["value"])
