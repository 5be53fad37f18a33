"""Delimited tweets: labelled and unlabelled lines to a sweep over label shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspring.functions.text import with_hashed_counts
from labelspring.operators.labels import apply_label_index, fit_label_index
from labelspring.operators.splits import hash_split
from labelspring.plans.bayes import Params
from labelspring.plans.em import EMParams, em_rows
from labelspring.plans.trials import share_sweep
from labelspring.runtime import durable

# Shares of the labelled set, share of the unlabelled set, test weights.
LABELLED_SHARES = (0.7, 0.8, 0.9)
UNLABELLED_SHARE = 0.1
TEST_WEIGHTS = (9, 1)


def without_neutral(df: DataFrame, polarity: str = "polarity", neutral: str = '"2') -> DataFrame:
    """Drop the neutral class, and rows without a polarity."""
    return df.where(F.col(polarity) != neutral)


def with_row_id(df: DataFrame, name: str = "doc_id") -> DataFrame:
    """Number the rows; written out once, so that the numbers stay what they are."""
    return durable(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


def experiment(
    labelled: DataFrame,
    unlabelled: DataFrame,
    params: Params,
    shares: Sequence[float] = LABELLED_SHARES,
    free_share: float = UNLABELLED_SHARE,
    seed: int = 0,
    em: EMParams = EMParams(max_epoch=6),
    hash_fn: str = "md5",
) -> DataFrame:
    """Supervised and EM accuracy per share of the labels.

    Inputs as read by the tweet sources.  A tenth of the labelled rows is held
    back for testing, a tenth of the unlabelled ones is used.
    """
    codes = fit_label_index(labelled, "polarity")
    coded = apply_label_index(labelled, codes, "polarity", name=params.label)
    known = with_hashed_counts(
        with_row_id(coded.select(params.label, "words")), "words", params.n_features, hash_fn
    )
    free = with_hashed_counts(
        with_row_id(unlabelled.select("words")).withColumn("doc_id", -1 - F.col("doc_id")),
        "words", params.n_features, hash_fn,
    )
    train, test = hash_split(known, "doc_id", TEST_WEIGHTS, seed)
    rows = em_rows(train, free, test, params, "doc_id")
    return share_sweep(rows, params, shares, free_share, seed, em)
