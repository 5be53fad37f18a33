"""A fitted classifier as one value: fit, predict, save, load.

A saved classifier is a folder with three parts: ``cells`` (the model's table), ``codes``
(text labels and their numbers) and ``record`` (format, parameters).  The record is written
last, so a folder is either complete or no classifier; nothing in it refers to another place.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelspring import storage
from labelspring.functions.text import regex_tokens, with_hashed_counts
from labelspring.operators.labels import apply_label_index, fit_label_index
from labelspring.plans import bayes, em, scoring
from labelspring.runtime import durable

FORMAT = 1


@dataclass(frozen=True)
class Settings:
    """``text`` and ``label`` name the input's columns; ``hash_fn`` as in :mod:`functions.text`."""

    text: str = "text"
    label: str = "label"
    id_col: str = "doc_id"
    hash_fn: str = "md5"
    way: str = "inline"


@dataclass(frozen=True)
class TextClassifier:
    """Texts in, names of classes out."""

    model: bayes.Model
    codes: DataFrame
    settings: Settings

    @staticmethod
    def fit(
        docs: DataFrame, params: bayes.Params, settings: Settings = Settings(), expectation: em.EMParams | None = None
    ) -> TextClassifier:
        """Fit on the labelled rows; with ``expectation`` the others (null label) improve the model."""
        s = settings
        labelled = docs.where(F.col(s.label).isNotNull())
        codes = durable(fit_label_index(labelled, s.label), "codes")
        own = replace(params, label="_number", buckets="buckets", counts="counts")
        known = apply_label_index(labelled, codes, s.label, name="_number").select(s.id_col, s.text, "_number")
        if expectation is None:
            return TextClassifier(bayes.fit(_counted(known, own, s, "_number"), own).frozen("cells"), codes, s)
        free = docs.where(F.col(s.label).isNull()).select(s.id_col, s.text, F.lit(None).cast(known.schema["_number"].dataType).alias("_number"))
        rows = em.partial_rows(_counted(known.unionByName(free), own, s, "_number"), own, s.id_col)
        result = em.run_em(rows, own, replace(expectation, way=s.way), s.id_col)
        return TextClassifier(result.model, codes, s)

    def transform(self, docs: DataFrame, name: str = "prediction") -> DataFrame:
        """``docs`` with the predicted class in ``name``; all other columns stay."""
        s = self.settings
        kept = [c for c in docs.columns if c != name]
        packed = docs.select(F.struct(*kept).alias("_row"), F.col(s.id_col).alias(s.id_col), F.col(s.text).alias("_text"))
        counted = with_hashed_counts(packed, regex_tokens("_text"), self.model.params.n_features, s.hash_fn, keep=("_row", s.id_col))
        done = scoring.transform(counted, self.model, s.id_col, s.way, keep_scores=False)
        names = self.codes.select(F.col("label").alias("prediction"), F.col("value").alias("_class"))
        return done.join(names, "prediction", "left").select("_row.*", F.col("_class").alias(name))

    def save(self, path: str) -> None:
        """Write the classifier to a new folder."""
        spark = self.codes.sparkSession
        if storage.exists(spark, path):
            raise FileExistsError(f"{path} exists; a classifier is written to a folder of its own")
        self.model.cells.write.parquet(f"{path}/cells")
        self.codes.write.parquet(f"{path}/codes")
        record = {
            "format": FORMAT, "params": asdict(self.model.params), "settings": asdict(self.settings), "runs": list(self.model.runs),
        }
        storage.write_record(spark, f"{path}/record", record)

    @staticmethod
    def load(spark: SparkSession, path: str) -> TextClassifier:
        record = storage.read_record(spark, f"{path}/record")
        if record is None:
            raise FileNotFoundError(f"{path} holds no complete classifier")
        if record.get("format") != FORMAT:
            raise ValueError(f"format {record.get('format')!r} is not known; this version reads format {FORMAT}")
        model = bayes.Model(spark.read.parquet(f"{path}/cells"), bayes.Params(**record["params"]), tuple(record["runs"]), True)
        return TextClassifier(model, spark.read.parquet(f"{path}/codes"), Settings(**record["settings"]))


def _counted(docs: DataFrame, params: bayes.Params, settings: Settings, *keep: str) -> DataFrame:
    return with_hashed_counts(docs, regex_tokens(settings.text), params.n_features, settings.hash_fn, keep=(settings.id_col, *keep))
