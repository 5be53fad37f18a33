"""Line and whole-file text scans, file provenance, delimited fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelspring.functions import sql
from labelspring.functions.text import space_tokens
from labelspring.operators.ranking import rank_within
from labelspring.runtime import durable

# 0-based field positions of the two delimited tweet layouts.
COMMA_FIELDS = {"polarity": 3, "text": 5}
TAB_FIELDS = {"polarity": 1, "text": 3}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row ``value`` per line."""
    return spark.read.text(path)


def read_lines_with_file(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the name of the file they came from."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("filename"))


def read_ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with ``filename`` and ``line``, their number in the file (from 0).

    A large file is read in blocks by several tasks.  Lines are ordered by the start of
    their block, then by their place in it, and numbered by exact ranks over ranges of that
    order, so a file that holds most of the input is spread like the rest.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("filename"),
        F.col("_metadata.file_block_start").alias("_block"),
        # a block is read by one task from its start to its end
        F.monotonically_increasing_id().alias("_place"),
    )
    # written once, so that the places stay what they are
    ranked = rank_within(durable(lines, "lines"), "filename", [F.col("_block"), F.col("_place")], "line")
    return ranked.select("value", "filename", "line")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file.

    A file is a document, so reading it whole gives its text in order without
    grouping its lines back together through a shuffle.
    """
    return spark.read.text(path, wholetext=True).select(
        F.col("value").alias("text"), F.col("_metadata.file_path").alias("filename")
    )


def path_part(path: str, from_end: int) -> str:
    """SQL: path element counted from the end; 1 is the last, null when too short."""
    return f"try_element_at(split({path}, '/'), -{int(from_end)})"


def with_topic_and_id(df: DataFrame, path: str = "filename") -> DataFrame:
    """``.../<topic>/<ID>`` to columns, at any depth."""
    return df.selectExpr("*", f"{path_part(path, 1)} AS ID", f"{path_part(path, 2)} AS topic")


def delimited_field(line: str, separator: str, position: int) -> str:
    """SQL: field by position, null when the line is too short; no quoting."""
    plain = sql.literal("\\Q" + separator + "\\E")
    return f"get(split({line}, {plain}), {int(position)})"


def tweets(
    lines: DataFrame, separator: str, fields: dict[str, int], labelled: bool = True
) -> DataFrame:
    """Delimited lines to ``polarity, words`` (``words`` alone when unlabelled)."""
    words = space_tokens(delimited_field("value", separator, fields["text"])) + " AS words"
    if not labelled:
        return lines.selectExpr(words)
    polarity = delimited_field("value", separator, fields["polarity"]) + " AS polarity"
    return lines.selectExpr(polarity, words)


def read_comma_tweets(spark: SparkSession, path: str, labelled: bool = True) -> DataFrame:
    return tweets(read_lines(spark, path), ",", COMMA_FIELDS, labelled)


def read_tab_tweets(spark: SparkSession, path: str, labelled: bool = True) -> DataFrame:
    return tweets(read_lines(spark, path), "\t", TAB_FIELDS, labelled)


def write_lines(df: DataFrame, path: str, *partition_by: str) -> None:
    """Text sink: one string column, optionally one folder per key value."""
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.text(path)
