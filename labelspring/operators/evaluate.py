"""Accuracy, trial summaries, corpus summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accuracy(
    df: DataFrame, label: str = "label", prediction: str = "prediction", *by: str, total: int | None = None
) -> DataFrame:
    """Share of rows whose prediction equals the label, optionally over a given row count."""
    hits = F.count_if(F.col(label) == F.col(prediction))
    rows = F.count("*") if total is None else F.lit(total)
    return df.groupBy(*by).agg(
        rows.cast("bigint").alias("n_rows"),
        F.try_divide(hits.cast("double"), rows.cast("double")).alias("accuracy"),
    )


def trial_summary(trials: DataFrame, *by: str) -> DataFrame:
    """Mean and population standard deviation of every accuracy (columns ``acc_<name>``)."""
    names = [c.removeprefix("acc_") for c in trials.columns if c.startswith("acc_")]
    return trials.groupBy(*by).agg(
        F.count("*").alias("n_trials"),
        *[f(f"acc_{n}").alias(f"{kind}_{n}") for n in names for kind, f in (("mean", F.avg), ("sd", F.stddev_pop))],
    )


def corpus_summary(df: DataFrame, label: str = "label") -> DataFrame:
    """Labelled rows, label-0 rows, their ratio, unlabelled rows, in one pass."""
    counts = df.agg(
        F.count(label).alias("n_labelled"),
        F.count_if(F.col(label) == 0).alias("n_label0"),
        F.count_if(F.col(label).isNull()).alias("n_unlabelled"),
    )
    return counts.withColumn(
        "ratio", F.try_divide(F.col("n_label0").cast("double"), F.col("n_labelled").cast("double"))
    )
