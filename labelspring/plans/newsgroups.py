"""Newsgroup corpora: message files to indexed Parquet to trials."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelspring.functions.text import regex_tokens, with_hashed_counts, without_stop_words
from labelspring.operators.labels import apply_label_index, fit_label_index, with_instance_index
from labelspring.plans.bayes import Params
from labelspring.plans.em import EMParams
from labelspring.plans.trials import trial_grid
from labelspring.sources.corpus import write_corpus
from labelspring.sources.text import read_files, with_topic_and_id

# Output files of the training and the test corpus, and the sweep.
TRAIN_FILES, TEST_FILES = 200, 10
SUPERVISED_SIZES = (1, 2, 4, 8, 16, 32, 64, 128, 256, 512)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """``ID, topic, words`` of files laid out as ``.../<topic>/<ID>``."""
    located = with_topic_and_id(read_files(spark, path))
    return located.selectExpr("ID", "topic", f"{regex_tokens('text')} AS words")


def index_messages(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add ``ind`` to both sets; test keeps only the topics of the training set."""
    return (
        with_instance_index(train, "topic", "ID"),
        with_instance_index(test, "topic", "ID", topics=train),
    )


def write_messages(
    train: DataFrame,
    test: DataFrame,
    train_path: str,
    test_path: str,
    train_files: int = TRAIN_FILES,
    test_files: int = TEST_FILES,
) -> None:
    """Write both sets to the given number of files."""
    write_corpus(train, train_path, train_files)
    write_corpus(test, test_path, test_files)


def features(df: DataFrame, codes: DataFrame, params: Params, hash_fn: str = "md5") -> DataFrame:
    """Stop words out, hashed counts, train-fitted codes.

    ``doc_id`` tells apart messages that were filed under several topics.
    """
    coded = apply_label_index(df, codes, "topic", name=params.label).withColumn(
        "doc_id", F.concat_ws("/", "topic", "ID")
    )
    kept = [c for c in ("doc_id", params.label, "ind") if c in coded.columns]
    return with_hashed_counts(
        coded, without_stop_words("words"), params.n_features, hash_fn, keep=tuple(kept)
    )


def experiment(
    train: DataFrame,
    test: DataFrame,
    params: Params,
    sizes: Sequence[int] = SUPERVISED_SIZES,
    trials: int = 10,
    seed: int = 0,
    em: EMParams = EMParams(min_improvement=1e-5),
) -> DataFrame:
    """Accuracy of the supervised and the EM model for every size and trial."""
    codes = fit_label_index(train, "topic")
    grid, _ = trial_grid(
        features(train, codes, params), features(test, codes, params), params, sizes, trials, seed, em
    )
    return grid
