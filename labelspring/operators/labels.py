"""Label codes, per-topic instance indexes and the figures derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspring.operators.ranking import rank_within
from labelspring.runtime import durable


def fit_label_index(df: DataFrame, column: str) -> DataFrame:
    """``(value, n, label)``: codes 0..k-1, most frequent first, ties by value.

    One row per class is ranked over range partitions, so any number of classes
    will do.  The codes are written out, so that joins on them know their exact size and
    broadcast them only if they are small.
    """
    counts = (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count("*").alias("n"))
    )
    ranked = rank_within(counts.withColumn("_all", F.lit(0)), "_all", [F.desc("n"), F.asc("value")], "label")
    return durable(ranked.select("value", "n", F.col("label").cast("int").alias("label")), "codes")


def apply_label_index(
    df: DataFrame, codes: DataFrame, column: str, unseen: str = "error", name: str = "label"
) -> DataFrame:
    """Attach fitted codes.

    Values without a code fail the job (``error``), are dropped (``skip``) or
    share the extra code k (``keep``), as do nulls.
    """
    if unseen not in ("error", "skip", "keep"):
        raise ValueError("unseen must be 'error', 'skip' or 'keep'")
    table = codes.select(F.col("value").alias("_value"), F.col("label").alias("_code"))
    how = "inner" if unseen == "skip" else "left"
    joined = df.join(table, F.col(column) == F.col("_value"), how)
    code: Column = F.col("_code")
    if unseen == "error":
        message = F.concat(
            F.lit("label value without a code: "), F.coalesce(F.col(column).cast("string"), F.lit("null"))
        )
        code = F.when(code.isNull(), F.raise_error(message).cast("int")).otherwise(code)
    elif unseen == "keep":
        extra = codes.agg(F.count("*").cast("int").alias("_extra"))
        joined = joined.withColumn("_extra", extra.scalar())
        code = F.coalesce(code, F.col("_extra"))
    return joined.withColumn(name, code).drop("_value", "_code", "_extra")


def topic_instance_index(df: DataFrame, topic: str, id_col: str) -> DataFrame:
    """``(topic, id, n, ind)``: IDs of a topic numbered from 0, most frequent first.

    Rows with the same ID share the index, so IDs are counted first and only
    the distinct ones are ranked.
    """
    ids = df.groupBy(topic, id_col).agg(F.count("*").alias("n"))
    return rank_within(ids, topic, [F.desc("n"), F.asc(id_col)])


def with_instance_index(
    df: DataFrame, topic: str, id_col: str, topics: DataFrame | None = None
) -> DataFrame:
    """Rows with their ``ind``; ``topics`` restricts to the topics it holds."""
    rows = df
    if topics is not None:
        # written out for its exact size: a shuffle on the topic would be skewed
        allowed = durable(distinct_topics(topics, topic), "topics")
        rows = df.join(allowed, topic, "left_semi")
    index = topic_instance_index(rows, topic, id_col).select(topic, id_col, "ind")
    return rows.join(index, [topic, id_col])


def topic_profile(df: DataFrame, topic: str, id_col: str, ind: str = "ind") -> DataFrame:
    """First ID (the one of the lowest index), largest index and row count per topic."""
    return df.groupBy(topic).agg(
        F.min_by(id_col, ind).alias("first_id"), F.max(ind).alias("max_ind"), F.count("*").alias("n_rows")
    )


def distinct_topics(df: DataFrame, topic: str) -> DataFrame:
    return df.select(topic).distinct()


def class_count(df: DataFrame, label: str = "label") -> DataFrame:
    """``max(label) + 1``."""
    return df.agg((F.max(label) + 1).cast("bigint").alias("n_classes"))


def smallest_class(df: DataFrame, label: str = "label", ind: str = "ind") -> DataFrame:
    """Size of the smallest class: min over labels of max(ind), plus one."""
    tops = df.groupBy(label).agg(F.max(ind).alias("_top"))
    return tops.agg((F.min("_top") + 1).cast("bigint").alias("min_class"))
