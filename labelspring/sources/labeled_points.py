"""Training rows as text: ``(label, (size,[indices],[values]), [weights], groundTruth)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SCALAR = r"([^()\[\],]+)"
_LIST = r"\[([^()\[\]]*)\]"
_TRAIL = r"\s*,?\s*"
_POINT = (
    rf"^\s*\({_SCALAR},\s*"
    rf"(?:\({_SCALAR},\s*{_LIST}\s*,\s*{_LIST}{_TRAIL}\)|{_LIST})"
    rf"\s*,\s*{_LIST}\s*,\s*{_SCALAR}{_TRAIL}\)\s*$"
)


def format_point(
    label: Column, size: int, buckets: Column, values: Column, weights: Column, ground_truth: Column
) -> Column:
    """One row as text; the feature vector is written sparse, the weights dense."""

    def listed(column: Column, kind: str) -> Column:
        return F.concat(
            F.lit("["),
            F.concat_ws(",", F.transform(column, lambda x: x.cast(kind).cast("string"))),
            F.lit("]"),
        )

    return F.concat(
        F.lit("("), label.cast("double").cast("string"),
        F.lit(f", ({size},"), listed(buckets, "int"), F.lit(","), listed(values, "double"),
        F.lit("), "), listed(weights, "double"),
        F.lit(", "), ground_truth.cast("double").cast("string"), F.lit(")"),
    )


def _group(line: Column, index: int) -> Column:
    return F.regexp_extract(line, _POINT, index)


def _numbers(text: Column) -> Column:
    """Comma-separated numbers; one trailing comma is accepted, null marks a bad item."""
    body = F.regexp_replace(text, r",\s*$", "")
    items = F.when(F.trim(body) == "", F.array().cast("array<string>")).otherwise(F.split(body, ","))
    return F.transform(items, lambda x: F.trim(x).try_cast("double"))


def _index(x: Column) -> Column:
    """A feature index: a whole number, else null."""
    return F.when(x == F.floor(x), x.try_cast("int"))


def parse_points(df: DataFrame, line: str = "value") -> DataFrame:
    """Parse the text form; a line that does not parse keeps its text in ``_corrupt``.

    Indices must be whole, ascending and within the size, and no number may be NaN.

    Dense feature vectors are read as size, indices and values as well.
    """
    value = F.col(line)
    raw = df.select(
        "*",
        F.coalesce(value.rlike(_POINT), F.lit(False)).alias("_shape"),
        _group(value, 1).alias("_label"),
        _group(value, 2).alias("_size"),
        _numbers(_group(value, 3)).alias("_idx"),
        _numbers(_group(value, 4)).alias("_val"),
        _numbers(_group(value, 5)).alias("_dense"),
        _numbers(_group(value, 6)).alias("_weight"),
        _group(value, 7).alias("_truth"),
    )
    sparse = F.col("_size") != ""
    typed = raw.select(
        *df.columns,
        "_shape",
        F.trim("_label").try_cast("double").alias("label"),
        F.when(sparse, F.trim("_size").try_cast("int")).otherwise(F.size("_dense")).alias("size"),
        F.when(sparse, F.transform("_idx", _index))
        .otherwise(F.transform("_dense", lambda x, i: i))
        .alias("buckets"),
        F.when(sparse, F.col("_val")).otherwise(F.col("_dense")).alias("values"),
        F.col("_weight").alias("weight"),
        F.trim("_truth").try_cast("double").alias("groundTruth"),
    )

    def holds_null(name: str) -> Column:
        return F.exists(name, lambda x: x.isNull())

    bad = (
        ~F.col("_shape")
        | F.col("label").isNull()
        | F.col("size").isNull()
        | F.col("groundTruth").isNull()
        | holds_null("buckets")
        | holds_null("values")
        | holds_null("weight")
        | (F.size("buckets") != F.size("values"))
        | (F.size("buckets") > F.col("size"))
        | F.exists("buckets", lambda x: (x < 0) | (x >= F.col("size")))
        | (F.col("buckets") != F.array_sort(F.array_distinct("buckets")))
        | F.isnan("label") | F.isnan("groundTruth")
        | F.exists(F.concat("values", "weight"), F.isnan)
    )
    flagged = typed.withColumn("_bad", bad)
    parsed = ("label", "size", "buckets", "values", "weight", "groundTruth")
    kept = [c for c in df.columns if c not in parsed]
    return flagged.select(
        *kept,
        *[F.when(~F.col("_bad"), F.col(c)).alias(c) for c in parsed],
        F.when(F.col("_bad"), F.col(line)).alias("_corrupt"),
    )


def read_points(spark: SparkSession, path: str) -> DataFrame:
    return parse_points(spark.read.text(path)).drop("value")


def write_points(lines: DataFrame, path: str) -> None:
    lines.write.text(path)
