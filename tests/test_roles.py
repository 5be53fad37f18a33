"""A row goes to Python once, whatever the number of runs and classes it stands in."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelspring.plans import bayes, em, scoring

PARAMS = bayes.Params(6, smoothing=0.5)
RUNS = (0, 1, 2)
ROWS = "doc_id long, label int, buckets array<int>, counts array<int>, part string, known array<int>"


def documents(spark):
    rng, rows = random.Random(3), []
    for i in range(40):
        found = sorted(rng.sample(range(6), rng.randint(0, 4)))
        known = [r for r in RUNS if i < 12 or rng.random() < 0.3]
        part = "test" if i % 9 == 8 else "train"
        rows.append((i, i % 2, found, [rng.randint(1, 3) for _ in found], part, [] if part == "test" else known))
    return spark.createDataFrame([*rows, (99, 1, None, None, "train", [0])], ROWS)


@pytest.mark.parametrize("weighting", em.WEIGHTINGS)
def test_roles_give_the_cells_of_one_row_for_each_role(spark, weighting):
    rows = documents(spark)
    seed = rows.where("part = 'train' AND buckets IS NOT NULL").select(F.explode("known").alias("run"), "label", "buckets", "counts")
    model = bayes.Model(bayes.class_cells(seed, PARAMS), PARAMS, RUNS).frozen()
    scored = scoring.with_raw(rows, model, (0, 1), "doc_id")
    settings = em.EMParams(weighting=weighting, unlabeled_weight=0.25)
    assigned = em._assignments(scored, PARAMS, settings, (0, 1), RUNS, None if weighting == "hard" else {1: 0.75})
    assert assigned.count() == rows.count()
    single = assigned.select("buckets", "counts", "row_length", F.explode("roles").alias("r")).select(
        F.when(F.col("r.featured"), F.col("buckets")).otherwise(F.array().cast("array<int>")).alias("buckets"),
        "counts", "row_length", "r.run", "r.label", F.col("r.weight").alias("row_weight"), "r.counted", "r.row_bucket",
    )

    def cells(df):
        found = bayes.class_cells(df, PARAMS).collect()
        assert len({(r.run, r.label, r.bucket) for r in found}) == len(found)
        return {(r.run, r.label, r.bucket): (r.weight, r.mass, r.df) for r in found}

    got, want = cells(assigned), cells(single)
    assert got.keys() == want.keys() and {k[0] for k in got} == set(RUNS)
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-12), k


def test_inline_scores_equal_sums_over_the_entries(spark):
    rows = documents(spark).where("part = 'train' AND buckets IS NOT NULL")
    seed = rows.select(F.explode("known").alias("run"), "label", "buckets", "counts")
    model = bayes.Model(bayes.class_cells(seed, PARAMS), PARAMS, RUNS).frozen()
    dense = scoring.DenseModel.from_cells(model.cells.toArrow(), PARAMS, RUNS, (0, 1))
    bias, weights = dense.weights()
    for r in scoring.with_raw_inline(rows, dense).collect():
        want = bias + sum((weights[:, b] * c for b, c in zip(r.buckets, r.counts)), np.zeros(6))
        assert r.raw == pytest.approx(list(want), rel=1e-12)
