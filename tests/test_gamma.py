import math

import pytest

from labelspring.functions.gamma import SHIFT, log2_gamma, log_gamma
from labelspring.plans import bayes, likelihood

VALUES = [1e-300, 1e-9, 0.1, 0.5, 1.0, 1.5, 2.0, 3.0, SHIFT - 1e-9, float(SHIFT), 10.5, 171.6, 1e6, 1e15, 1e300] + [
    -0.5, -1.5, -2.25, -7.999, -100.5, -1e-9, -33.3
]


def test_values_against_the_library(spark):
    rows = spark.createDataFrame([(v,) for v in VALUES + [i / 37 for i in range(1, 600)]], "x double")
    for r in rows.selectExpr("x", f"{log_gamma('x')} AS y", f"{log2_gamma('x')} AS bits").collect():
        want = math.lgamma(r.x)
        assert r.y == pytest.approx(want, rel=1e-12, abs=1e-9), r.x
        assert r.bits == pytest.approx(want / math.log(2.0), rel=1e-12, abs=1e-9)


def test_poles_and_missing_values(spark):
    rows = spark.createDataFrame([(0, 0.0), (1, -3.0), (2, None), (3, math.nan), (4, math.inf)], "i int, x double")
    got = {r.i: r.y for r in rows.selectExpr("i", f"{log_gamma('x')} AS y").collect()}
    assert got[0] == got[1] == got[4] == math.inf and got[2] is None and math.isnan(got[3])


@pytest.fixture(scope="module")
def model(spark):
    rows = spark.createDataFrame(
        [(0, [0, 2], [1, 3]), (0, [1], [2]), (1, [2, 4], [1, 1])], "label int, buckets array<int>, counts array<int>"
    )
    return bayes.fit(rows, bayes.Params(n_features=6, smoothing=0.3)).frozen()


def density(model, alpha):
    full = bayes.full_theta(model).collect()
    out = {}
    for label in {r.label for r in full}:
        own = [(alpha(label, r.bucket), r.log_theta) for r in full if r.label == label]
        out[label] = (
            math.lgamma(sum(a for a, _ in own)) - sum(math.lgamma(a) for a, _ in own) + sum((a - 1) * t for a, t in own)
        ) / math.log(2.0)
    return out


def test_density_by_feature(spark, model):
    by_feature = {0: 0.5, 2: 3.0, 5: 1.25}  # the others have 1
    table = spark.createDataFrame(list(by_feature.items()), "bucket int, alpha double")
    got = {r.label: r.dirichlet_log2 for r in likelihood.dirichlet_log2_prior_by_feature(model, table).collect()}
    assert got == pytest.approx(density(model, lambda c, b: by_feature.get(b, 1.0)))
    both = {(0, 1): 0.2, (1, 4): 2.0, (1, 0): 0.7}
    table = spark.createDataFrame([(c, b, a) for (c, b), a in both.items()], "label int, bucket int, alpha double")
    got = {r.label: r.dirichlet_log2 for r in likelihood.dirichlet_log2_prior_by_feature(model, table).collect()}
    assert got == pytest.approx(density(model, lambda c, b: both.get((c, b), 1.0)))
    same = spark.createDataFrame([(b, 0.5) for b in range(6)], "bucket int, alpha double")
    one = {r.label: r.dirichlet_log2 for r in likelihood.dirichlet_log2_prior(model, 0.5).collect()}
    got = {r.label: r.dirichlet_log2 for r in likelihood.dirichlet_log2_prior_by_feature(model, same).collect()}
    assert got == pytest.approx(one)


@pytest.mark.parametrize("bad", [0.0, -1.0, math.inf, math.nan])
def test_bad_parameters_fail(spark, model, bad):
    table = spark.createDataFrame([(0, bad)], "bucket int, alpha double")
    with pytest.raises(Exception, match="alpha must be positive"):
        likelihood.dirichlet_log2_prior_by_feature(model, table).collect()
