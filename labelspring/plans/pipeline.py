"""The same classifier as a ``pyspark.ml`` pipeline on vector columns."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import HashingTF, Normalizer, StopWordsRemover, StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def feature_pipeline(
    n_features: int, topic: str = "topic", words: str = "words", label: str = "label", unseen: str = "error"
) -> Pipeline:
    """Stop words out, hashed counts, label codes; fitted on train, applied to both sets."""
    return Pipeline(
        stages=[
            StopWordsRemover(inputCol=words, outputCol="keywords"),
            HashingTF(inputCol="keywords", outputCol="features", numFeatures=n_features),
            StringIndexer(
                inputCol=topic, outputCol=label, stringOrderType="frequencyDesc", handleInvalid=unseen
            ),
        ]
    )


def fit_features(train: DataFrame, n_features: int) -> PipelineModel:
    return feature_pipeline(n_features).fit(train)


def fit_normalised(train: DataFrame, smoothing: float, label: str = "label"):
    """Naive Bayes fitted on unit-length vectors and set to score raw counts."""
    unit = Normalizer(p=1.0, inputCol="features", outputCol="unit").transform(train)
    codes = unit.agg(F.count_distinct(label).alias("k"), F.max(label).alias("top")).first()
    if codes["k"] != int(codes["top"]) + 1:
        # ml models number the classes by position, so a gap would shift them
        raise ValueError("label codes must be 0..k-1 without a gap")
    model = NaiveBayes(
        featuresCol="unit", labelCol=label, smoothing=smoothing, modelType="multinomial"
    ).fit(unit)
    return model.setFeaturesCol("features")


def classify(train: DataFrame, test: DataFrame, n_features: int, smoothing: float) -> DataFrame:
    """Fit on train, predict test."""
    features = fit_features(train, n_features)
    model = fit_normalised(features.transform(train), smoothing)
    return model.transform(features.transform(test))


def sparse_counts(df: DataFrame, *keep: str, id_col: str = "doc_id", label: str = "label") -> DataFrame:
    """``features`` vectors as ``buckets`` and ``counts``, read from the vector's own arrays."""
    vector = df.withColumn("_v", F.unwrap_udt("features"))
    return vector.select(
        id_col, F.col(label).cast("int").alias(label), *keep,
        F.expr("CAST(aggregate(_v.values, 0D, (s, y) -> s + y) AS BIGINT)").alias("n_terms"),
        # dense vectors have no indices
        F.expr("coalesce(_v.indices, CAST(sequence(0, size(_v.values) - 1) AS ARRAY<INT>))").alias("buckets"),
        F.expr("transform(_v.values, x -> CAST(x AS INT))").alias("counts"),
    )
