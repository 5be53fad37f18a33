"""Counts, ratios, document building and previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspring.functions.text import explode_counts


def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows of label 0 and 1 and the share of label 0, in one pass."""
    counts = df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col(label) == 0).alias("n_label0"),
        F.count_if(F.col(label) == 1).alias("n_label1"),
    )
    both = F.col("n_label0") + F.col("n_label1")
    return counts.withColumn("ratio", F.try_divide(F.col("n_label0").cast("double"), both))


def lines_to_documents(lines: DataFrame, key: str, line_no: str, tokens: str) -> DataFrame:
    """Group the lines of a document: ``(key, words)`` in line order, one row per document.

    Every token is kept, duplicates included, so a row is as long as its document.
    For modelling use ``document_counts``, whose rows are bounded by the features.
    """
    grouped = lines.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct(F.col(line_no), F.col(tokens)))).alias("_lines")
    )
    return grouped.select(key, F.flatten(F.col(f"_lines.{tokens}")).alias("words"))


def document_terms(lines: DataFrame, key: str, tokens: str) -> DataFrame:
    """Term counts of documents spread over lines, for documents of any length."""
    return (
        lines.select(key, F.explode(tokens).alias("term"))
        .groupBy(key, "term")
        .agg(F.count("*").alias("n"))
    )


def document_counts(lines: DataFrame, key: str) -> DataFrame:
    """Merge the hashed counts of lines (``buckets``, ``counts``) into one row per document.

    Counts are summed per (document, bucket) before the rows are collected, so
    a collected row holds at most one entry per feature.
    """
    cells = explode_counts(lines, key).groupBy(key, "bucket").agg(F.sum("tf").alias("tf"))
    packed = cells.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("bucket", "tf"))).alias("_cells"),
        F.sum("tf").cast("int").alias("n_terms"),
    )
    return packed.select(
        key,
        F.col("_cells.bucket").alias("buckets"),
        F.col("_cells.tf").cast("array<int>").alias("counts"),
        "n_terms",
    )


def preview(df: DataFrame, *order: Column | str, n: int = 20) -> DataFrame:
    """The first rows in a stated order."""
    return df.orderBy(*order).limit(n)
