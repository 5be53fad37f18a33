import random
from dataclasses import replace

import pytest

import brute
from labelspring.functions.text import regex_tokens, with_hashed_counts
from labelspring.operators import aggregates, evaluate
from labelspring.plans import em, likelihood, trials
from labelspring.plans.bayes import Params

V, LAM = 60, 0.2
PARAMS = Params(V, LAM)


def make_docs(seed=3, n=160):
    rng = random.Random(seed)
    names = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(30)]
    docs = []
    for i in range(n):
        y = rng.randrange(3)
        pool = names[y * 7 : y * 7 + 14]
        docs.append((i, " ".join(rng.choices(pool, k=rng.randrange(0, 12))), y, i % 4 == 0))
    return docs


DOCS = make_docs()


@pytest.fixture(scope="module")
def counted(spark):
    df = spark.createDataFrame(DOCS, "doc_id int, text string, truth int, known boolean")
    return with_hashed_counts(
        df, regex_tokens("text"), V, keep=("doc_id", "text", "truth", "known")
    ).cache()


@pytest.fixture(scope="module")
def rows(counted):
    partial = counted.selectExpr("doc_id", "buckets", "counts", "IF(known, truth, NULL) AS label")
    return em.partial_rows(partial, PARAMS, "doc_id").cache()


def expected(weight=1.0, soft=False, epochs=3):
    labelled = [(y, brute.counts(t, V)) for _, t, y, k in DOCS if k]
    free = [brute.counts(t, V) for _, t, _, k in DOCS if not k]
    return brute.em(labelled, free, V, LAM, epochs, weight, soft)


@pytest.mark.parametrize("weighting, weight", [("hard", 1.0), ("row", 0.5), ("soft", 0.5), ("soft", 1.0)])
@pytest.mark.parametrize("way", ["inline", "joined"])
def test_trace_and_model_match_brute_force(rows, weighting, weight, way):
    result = em.run_em(
        rows, PARAMS, em.EMParams(max_epoch=3, weighting=weighting, unlabeled_weight=weight, way=way)
    )
    models, logs = expected(1.0 if weighting == "hard" else weight, weighting == "soft")
    trace = result.trace.orderBy("epoch").collect()
    assert [r.epoch for r in trace] == [1, 2, 3]
    assert trace[0].improvement is None
    for r, (bits, nats), model in zip(trace, logs, models):
        assert r.model_log_prob == pytest.approx(bits)
        assert r.data_log_prob == pytest.approx(nats)
        hits = [brute.best(brute.raw(model, brute.counts(t, V))) == y for _, t, y, k in DOCS if k]
        assert r.acc_train == pytest.approx(sum(hits) / len(hits))
        assert r.acc_test is None
    for r in result.model.prior.collect():
        assert r.pi == pytest.approx(models[3][r.label][0])
    assert trace[1].improvement == pytest.approx(
        likelihood.relative_difference(sum(logs[1]), sum(logs[0]))
    )


def test_separate_inputs_equal_one_frame(counted, rows):
    labelled = counted.where("known").withColumnRenamed("truth", "label")
    free = counted.where("NOT known").drop("truth")
    built = em.em_rows(labelled, free, None, PARAMS, "doc_id")
    a = em.run_em(built, PARAMS, em.EMParams(max_epoch=2)).trace.collect()
    b = em.run_em(rows, PARAMS, em.EMParams(max_epoch=2)).trace.collect()
    assert [x.log_prob for x in a] == pytest.approx([x.log_prob for x in b])


def test_stop_rule_is_strict_and_never_fires_on_the_first_epoch(rows):
    def epochs(limit):
        return em.run_em(rows, PARAMS, em.EMParams(max_epoch=8, min_improvement=limit)).epochs[0]

    assert epochs(10.0) == 2
    assert epochs(0.0) == 8
    changes = [
        r.improvement for r in em.run_em(rows, PARAMS, em.EMParams(max_epoch=8)).trace.orderBy("epoch").collect()
    ]
    want = next((i + 1 for i, c in enumerate(changes) if c is not None and c < 1e-4), 8)
    assert epochs(1e-4) == want


def test_test_rows_are_scored_but_not_learned(counted, rows):
    held = counted.selectExpr("doc_id + 10000 AS doc_id", "truth AS label", "buckets", "counts", "'test' AS part", "CAST(array() AS ARRAY<INT>) AS known")
    both = em.run_em(rows.unionByName(held), PARAMS, em.EMParams(max_epoch=2)).trace.orderBy("epoch").collect()
    alone = em.run_em(rows, PARAMS, em.EMParams(max_epoch=2)).trace.orderBy("epoch").collect()
    assert [r.log_prob for r in both] == pytest.approx([r.log_prob for r in alone])
    models, _ = expected()
    hits = [brute.best(brute.raw(models[0], brute.counts(t, V))) == y for _, t, y, _ in DOCS]
    assert both[0].acc_test == pytest.approx(sum(hits) / len(hits))


def grid_inputs(counted):
    from labelspring.operators.labels import with_instance_index

    named = counted.withColumnRenamed("truth", "label").select("doc_id", "label", "buckets", "counts")
    train = with_instance_index(named.where("doc_id % 5 > 0"), "label", "doc_id")
    return train, named.where("doc_id % 5 = 0")


def test_joined_grid_equals_inline_grid(counted):
    train, test = grid_inputs(counted)
    found = []
    for way, limit in (("inline", 8_000_000), ("joined", 1)):
        params = replace(PARAMS, inline_cells=limit)
        settings = em.EMParams(max_epoch=2, way=way)
        grid, _ = trials.trial_grid(train, test, params, (4,), 2, 11, settings)
        found.append(sorted(tuple(r) for r in grid.collect()))
    assert found[0] == found[1] and len(found[0]) == 2


@pytest.mark.parametrize("limit", [8_000_000, 3 * V, 7 * V])
def test_grid_runs_equal_single_runs(counted, limit):
    train, test = grid_inputs(counted)
    params = replace(PARAMS, inline_cells=limit)
    settings = em.EMParams(max_epoch=4, min_improvement=1e-3)
    grid, result = trials.trial_grid(train, test, params, (1, 4, 16), 2, 11, settings)
    got = {(r.n_sup, r.trial): r for r in grid.collect()}
    assert len(got) == 6
    by_class = {}
    for r in train.select("doc_id", "label", "ind").collect():
        by_class.setdefault(r.label, {})[r.ind] = r.doc_id
    text = {d[0]: d[1] for d in DOCS}
    truth = {d[0]: d[2] for d in DOCS}
    for r in got.values():
        chosen = {ids[i] for ids in by_class.values() for i in range(r.start, r.start + r.n_sup) if i in ids}
        train_ids = [d for ids in by_class.values() for d in ids.values()]
        labelled = [(truth[d], brute.counts(text[d], V)) for d in train_ids if d in chosen]
        free = [brute.counts(text[d], V) for d in train_ids if d not in chosen]
        models, logs = brute.em(labelled, free, V, LAM, 4)
        totals = [sum(x) for x in logs]
        stop = next(
            (e for e in range(2, 5) if likelihood.relative_difference(totals[e - 1], totals[e - 2]) < 1e-3), 4
        )
        assert r.epochs == stop
        for model, acc in ((models[0], r.acc_sup), (models[stop], r.acc_em)):
            hits = [
                brute.best(brute.raw(model, brute.counts(t, V))) == y for i, t, y, _ in DOCS if i % 5 == 0
            ]
            assert acc == pytest.approx(sum(hits) / len(hits))


def test_inline_refuses_a_model_beyond_its_limit(rows):
    small = replace(PARAMS, inline_cells=V)
    with pytest.raises(ValueError, match="inline_cells"):
        em.run_em(rows, small, em.EMParams(max_epoch=1))
    a = em.run_em(rows, small, em.EMParams(max_epoch=2, way="joined")).trace.collect()
    b = em.run_em(rows, PARAMS, em.EMParams(max_epoch=2)).trace.collect()
    assert [x.log_prob for x in a] == pytest.approx([x.log_prob for x in b])


def test_rows_kept_in_a_table(rows):
    a = em.run_em(rows, PARAMS, em.EMParams(max_epoch=2, keep="table")).trace.collect()
    b = em.run_em(rows, PARAMS, em.EMParams(max_epoch=2), cache=False).trace.collect()
    assert [x.log_prob for x in a] == pytest.approx([x.log_prob for x in b])


def test_bad_counts_fail_em(rows):
    bad = rows.withColumn("counts", em.F.transform("counts", lambda x: -x))
    with pytest.raises(Exception, match="nonnegative"):
        em.run_em(bad, PARAMS, em.EMParams(max_epoch=1))


def test_em_parameters_are_checked():
    for bad in (dict(max_epoch=0), dict(weighting="warm"), dict(unlabeled_weight=-1.0), dict(way="auto"), dict(keep="disk")):
        with pytest.raises(ValueError):
            em.EMParams(**bad)


def test_relative_change(spark):
    df = spark.createDataFrame([(0, 1, -4.0), (0, 2, -6.0), (0, 3, -6.0)], "run int, epoch int, log_prob double")
    got = [r.improvement for r in likelihood.with_relative_change(df).orderBy("epoch").collect()]
    assert got == [None, pytest.approx(0.4), 0.0]
    assert likelihood.relative_difference(1.0, None) is None


def test_trial_summary_uses_population_deviation(spark):
    from statistics import mean, pstdev

    rng = random.Random(0)
    data = [(n, t, rng.random(), rng.random()) for n in (1, 2) for t in range(5)]
    df = spark.createDataFrame(data, "n_sup int, trial int, acc_sup double, acc_em double")
    for r in evaluate.trial_summary(df, "n_sup").collect():
        em_acc = [d[3] for d in data if d[0] == r.n_sup]
        assert r.mean_em == pytest.approx(mean(em_acc)) and r.sd_em == pytest.approx(pstdev(em_acc))


def test_accuracy_and_counts(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (1, 1), (None, 1)], "label int, prediction int")
    assert evaluate.accuracy(df).first().accuracy == 0.5
    assert evaluate.accuracy(df, total=10).first().accuracy == pytest.approx(0.2)
    row = aggregates.label_counts(df).first()
    assert (row.n_label0, row.n_label1, row.n_rows) == (1, 2, 4)
    assert aggregates.label_counts(df.where("label IS NULL")).first().ratio is None
    assert evaluate.corpus_summary(df).first().asDict() == {
        "n_labelled": 3, "n_label0": 1, "n_unlabelled": 1, "ratio": pytest.approx(1 / 3)
    }


def test_long_documents_are_one_row(spark):
    lines = spark.createDataFrame([("hot", i, [f"w{i}"]) for i in range(2500)] + [("b", 0, ["x", "x"])], "k string, n int, words array<string>")
    docs = aggregates.lines_to_documents(lines, "k", "n", "words").collect()
    assert [r.words for r in docs if r.k == "hot"] == [[f"w{i}" for i in range(2500)]]
    assert [r.words for r in docs if r.k == "b"] == [["x", "x"]]
    terms = {(r.k, r.term): r.n for r in aggregates.document_terms(lines, "k", "words").collect()}
    assert terms[("b", "x")] == 2 and len(terms) == 2501
