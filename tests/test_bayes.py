import math

import pytest
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import Normalizer
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

import brute
from labelspring.functions import vectors
from labelspring.functions.text import regex_tokens, with_hashed_counts
from labelspring.plans import bayes, likelihood, pipeline, scoring

V, LAM = 40, 0.3
DOCS = [
    (0, "apple pear plum apple", 0), (1, "pear plum fig fig fig", 0), (2, "bolt screw nut", 2),
    (3, "nut nut nail", 2), (4, "", 2), (5, "apple bolt", None), (6, "", None), (7, "zebra", None),
    (8, "fig nail nail screw", None),
]


@pytest.fixture(scope="module")
def corpus(spark):
    df = spark.createDataFrame(DOCS, "doc_id int, text string, label int")
    return with_hashed_counts(df, regex_tokens("text"), V, keep=("doc_id", "text", "label")).cache()


@pytest.fixture(scope="module")
def expected():
    return brute.fit([(y, brute.counts(t, V), 1.0) for _, t, y in DOCS if y is not None], V, LAM)


PARAMS = bayes.Params(V, LAM)


def test_fit_matches_formula_and_keeps_labels(corpus, expected):
    # labels 0 and 2: the gap must not shift anything, and the empty document counts
    model = bayes.fit(corpus, PARAMS).frozen()
    prior = {r.label: r for r in model.prior.collect()}
    assert set(prior) == {0, 2} and prior[2].n == 3
    full = {(r.label, r.bucket): r.log_theta for r in bayes.full_theta(model).collect()}
    assert len(full) == 2 * V
    for y, (pi, theta) in expected.items():
        assert prior[y].pi == pytest.approx(pi, abs=1e-12)
        assert [full[y, j] for j in range(V)] == pytest.approx(theta, abs=1e-12)
        assert sum(math.exp(full[y, j]) for j in range(V)) == pytest.approx(1.0)


@pytest.mark.parametrize("way", ["inline", "joined"])
def test_scores_posteriors_predictions(corpus, expected, way):
    rows = scoring.transform(corpus, bayes.fit(corpus, PARAMS), way=way).collect()
    assert len(rows) == len(DOCS)
    for r in rows:
        want = brute.raw(expected, brute.counts(r.text, V))
        assert r.raw == pytest.approx([want[0], want[2]], abs=1e-9)
        assert sum(r.posterior) == pytest.approx(1.0)
        assert r.posterior == pytest.approx(list(brute.posterior(want).values()), abs=1e-9)
        assert r.prediction == brute.best(want)


@pytest.mark.parametrize("way", ["inline", "joined"])
def test_bernoulli_scores(corpus, way):
    params = bayes.Params(V, LAM, "bernoulli")
    ones = corpus.withColumn("counts", F.transform("counts", lambda x: F.lit(1)))
    model = bayes.fit(ones, params).frozen()
    prior = {r.label: r for r in model.prior.collect()}
    assert prior[0].log_denom == pytest.approx(math.log(2 + 2 * LAM))
    theta = {(r.label, r.bucket): r.log_theta for r in bayes.full_theta(model).collect()}
    for r in scoring.transform(corpus, model, way=way).collect():
        present = brute.counts(r.text, V)
        for i, y in enumerate((0, 2)):
            want = prior[y].pi + sum(
                theta[y, j] if j in present else math.log(1 - math.exp(theta[y, j])) for j in range(V)
            )
            assert r.raw[i] == pytest.approx(want, abs=1e-9)


def test_agrees_with_ml_naive_bayes(spark, corpus):
    two = corpus.where("label IS NOT NULL").withColumn("label", (F.col("label") / 2).cast("int"))
    ours = scoring.transform(two, bayes.fit(two, PARAMS)).collect()
    data = spark.createDataFrame(
        [(r.doc_id, float(r.label), SparseVector(V, r.buckets, [float(c) for c in r.counts])) for r in two.collect()],
        ["doc_id", "label", "features"],
    )
    unit = Normalizer(p=1.0, inputCol="features", outputCol="unit").transform(data)
    ml = NaiveBayes(featuresCol="unit", smoothing=LAM).fit(unit).setFeaturesCol("features")
    theirs = {r.doc_id: r for r in ml.transform(unit).collect()}
    for r in ours:
        assert r.raw == pytest.approx(list(theirs[r.doc_id].rawPrediction), abs=1e-9)
        assert r.prediction == theirs[r.doc_id].prediction
    assert pipeline.fit_normalised(data, LAM).pi.toArray() == pytest.approx(ml.pi.toArray())


def test_ml_path_rejects_label_gaps(spark):
    data = spark.createDataFrame([(0.0, SparseVector(2, [0], [1.0])), (2.0, SparseVector(2, [1], [1.0]))], ["label", "features"])
    with pytest.raises(ValueError, match="gap"):
        pipeline.fit_normalised(data, 1.0)


def test_without_normalisation(corpus):
    stock = bayes.fit(corpus, bayes.Params(V, LAM, normalise=False)).prior.collect()
    assert {r.label: r.mass for r in stock} == {0: 9.0, 2: 6.0}


def test_bad_features_fail_the_fit(spark):
    df = spark.createDataFrame([(1, 0, [0, 1], [1, -2])], "doc_id int, label int, buckets array<int>, counts array<int>")
    with pytest.raises(Exception, match="nonnegative, found -2"):
        bayes.fit(df, PARAMS).prior.collect()
    twos = df.withColumn("counts", F.expr("array(1, 2)"))
    with pytest.raises(Exception, match="0 or 1, found 2"):
        bayes.fit(twos, bayes.Params(V, LAM, "bernoulli")).prior.collect()


@pytest.mark.parametrize("bad", [dict(n_features=0), dict(n_features=5, smoothing=0), dict(n_features=5, model_type="gaussian")])
def test_parameters_are_checked_early(bad):
    with pytest.raises(ValueError):
        bayes.Params(**bad)


def test_no_labelled_row(corpus):
    with pytest.raises(ValueError, match="no class"):
        scoring.transform(corpus, bayes.fit(corpus.where("label IS NULL"), PARAMS))


def test_string_labels(spark):
    df = spark.createDataFrame([(0, "aa aa", "it's"), (1, "bb", "a\\b")], "doc_id int, text string, label string")
    rows = with_hashed_counts(df, regex_tokens("text"), V, keep=("doc_id", "label"))
    for way in ("inline", "joined"):
        done = scoring.transform(rows, bayes.fit(rows, PARAMS), way=way).collect()
        assert all(r.prediction == r.label for r in done)


def test_log_probabilities(corpus, expected):
    model = bayes.fit(corpus, PARAMS).frozen()
    bits = -sum(pi + sum(theta) for pi, theta in expected.values()) / math.log(2)
    nats = sum(
        expected[y][0] + sum(expected[y][1][j] for j in brute.counts(t, V)) for _, t, y in DOCS if y is not None
    )
    row = likelihood.log_probs(model).first()
    assert row.model_log_prob == pytest.approx(bits)
    assert row.data_log_prob == pytest.approx(nats)
    assert row.log_prob == pytest.approx(bits + nats)
    assert likelihood.log_probs(model, "bits").first().log_prob == pytest.approx(bits + nats / math.log(2))
    dense = scoring.DenseModel.from_cells(model.cells.toArrow(), PARAMS, (0,), (0, 2))
    assert dense.log_probs()[0] == pytest.approx((bits, nats))


def test_dirichlet(corpus, expected):
    model = bayes.fit(corpus, PARAMS).frozen()
    got = {r.label: r.dirichlet_log2 for r in likelihood.dirichlet_log2_prior(model, 0.5).collect()}
    for y, (_, theta) in expected.items():
        want = (math.lgamma(V * 0.5) - V * math.lgamma(0.5) - 0.5 * sum(theta)) / math.log(2)
        assert got[y] == pytest.approx(want)
    for alpha in (0.0, -1.0, math.inf, math.nan):
        with pytest.raises(ValueError):
            likelihood.dirichlet_log2_prior(model, alpha)


@pytest.mark.parametrize(
    "p, ranked, positional",
    [([0.9, 0.1], 1.0, 1.0), ([0.1, 0.9], 1.0, 0.0), ([0.5, 0.5], 0.0, 0.0), ([0.2, 0.3, 0.5], 0.2, 0.0), ([1.0], 1.0, 1.0)],
)
def test_certainty(spark, p, ranked, positional):
    df = spark.createDataFrame([(p,)], "p array<double>")
    row = df.selectExpr(f"{vectors.certainty('p')} AS a", f"{vectors.certainty('p', positional=True)} AS b").first()
    assert row.a == pytest.approx(ranked) and row.b == pytest.approx(positional)


def test_normalise_array(spark):
    df = spark.createDataFrame([([1.0, 3.0],), ([0.0, 0.0],), ([],)], "x array<double>")
    assert [r.n for r in df.selectExpr(f"{vectors.normalise('x')} AS n").collect()] == [[0.25, 0.75], [0.0, 0.0], []]


def test_cells_make_no_row_of_a_term(spark, monkeypatch):
    rows = spark.createDataFrame(
        [(0, "a", [0, 2], [1, 3]), (0, "a", [2], [2]), (1, None, [5, 900], [1, 1]), (1, "b", [], []), (1, "b", None, None)],
        "run int, label string, buckets array<int>, counts array<int>",
    ).coalesce(1)
    want = [
        (0, "a", -1, 2.0, 0.0, 2), (0, "a", 0, 1.0, 0.25, 1), (0, "a", 2, 2.0, 1.75, 2),
        (1, None, -1, 1.0, 0.0, 1), (1, None, 5, 1.0, 0.5, 1), (1, None, 900, 1.0, 0.5, 1),
        (1, "b", None, 1.0, 0.0, 1), (1, "b", -1, 1.0, 0.0, 1),
    ]
    for held in (bayes.HELD_CELLS, 10, 1):
        monkeypatch.setattr(bayes, "HELD_CELLS", held)
        cells = bayes.class_cells(rows, bayes.Params(1000))
        assert "Generate" not in cells._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, cells.collect()), key=str) == sorted(want, key=str)
