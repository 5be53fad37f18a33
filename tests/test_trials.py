"""Samples of a given size, roles per run, weights per run, joined grids, resumed EM."""

import hashlib
import statistics
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from labelspring.operators import evaluate, sampling
from labelspring.plans import bayes, em, scoring, trials

from test_em import PARAMS, counted, grid_inputs  # noqa: F401


def hash32(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def order(ids, seed, trial):
    return sorted(ids, key=lambda i: (hash32(i, seed, trial), i))


@pytest.mark.parametrize("ids", [range(500), [*range(-40, 40), *range(10_000, 10_100)]])
def test_samples_are_the_first_rows_of_a_seeded_order(spark, ids):
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(5)
    chosen = sampling.draws(df, "id", (1, 7, 60, 100_000), 3, 9)
    runs = df.select("id", sampling.drawn_runs(chosen, "id", 9).alias("runs")).collect()
    for d in chosen:
        want = set(order(ids, 9, d.trial)[: d.size])
        assert {r.id for r in runs if d.run in r.runs} == want
    assert [d.last_hash for d in chosen if d.size == 100_000] == [None] * 3


def test_equal_hashes_are_ordered_by_id(spark, monkeypatch):
    monkeypatch.setattr(sampling, "hash32", lambda *parts: (parts[0] % 3).cast("bigint"))
    df = spark.range(30).withColumnRenamed("id", "doc")
    found = {r.size: (r.hash, r.id) for r in sampling.nth_least(df, "doc", (1, 10, 11, 30, 31), (1,), 0).collect()}
    assert found == {1: (0, 0), 10: (0, 27), 11: (1, 1), 30: (2, 29)}


def test_text_ids_and_null_ids(spark):
    df = spark.createDataFrame([("it's",), ("b\\",), ("c",), (None,)], "id string")
    chosen = sampling.draws(df, "id", (2, 9), 1, 1)
    runs = {r.id: r.runs for r in df.select("id", sampling.drawn_runs(chosen, "id", 1).alias("runs")).collect()}
    first = order(["it's", "b\\", "c"], 1, 1)[:2]
    assert {i for i, r in runs.items() if r and 0 in r} == set(first)
    assert {i for i, r in runs.items() if r and 1 in r} == {"it's", "b\\", "c"} and not runs[None]


def test_random_grid_equals_single_runs(counted):
    train, test = grid_inputs(counted)
    settings = em.EMParams(max_epoch=2)
    grid, _ = trials.random_grid(train, test, PARAMS, (6, 30), 2, 5, settings)
    ids = [r.doc_id for r in train.select("doc_id").collect()]
    found = grid.collect()
    assert len(found) == 4
    for r in found:
        assert r.n_labelled == r.n_sup and r.n_rows == test.count()
    for r in (found[0], found[-1]):
        inside = F.col("doc_id").isin(order(ids, 5, r.trial)[: r.n_sup])
        rows = em.em_rows(train.where(inside), train.where(~inside), test, PARAMS, "doc_id")
        single = em.run_em(rows, PARAMS, settings)
        assert r.acc_sup == pytest.approx(single.trace.where("epoch = 1").first().acc_test)
        assert r.acc_em == pytest.approx(em.run_accuracy(test, single.model).first().accuracy)
    joined, _ = trials.random_grid(train, test, PARAMS, (6, 30), 2, 5, replace(settings, way="joined"))
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, found))


def test_variants_of_a_cell_equal_single_runs(counted):
    train, test = grid_inputs(counted)
    settings = em.EMParams(max_epoch=3, weighting="row")
    grid, _ = trials.weighted_grid(train, test, PARAMS, (2, 8), 2, 3, settings, {"full": 1.0, "low": 0.05})
    found = grid.collect()
    assert len(found) == 4
    for r in (found[0], found[-1]):
        inside = (F.col("ind") >= r.start) & (F.col("ind") < r.start + r.n_sup)
        rows = em.em_rows(train.where(inside), train.where(~inside), test, PARAMS, "doc_id")
        for name, weight in (("full", 1.0), ("low", 0.05)):
            single = em.run_em(rows, PARAMS, replace(settings, unlabeled_weight=weight))
            assert r[f"acc_{name}"] == pytest.approx(em.run_accuracy(test, single.model).first().accuracy)
    with pytest.raises(ValueError, match="hard"):
        em.run_em(rows, PARAMS, em.EMParams(), weights={0: 0.5})


def test_roles_of_the_share_trials(spark, counted):
    rows = counted.withColumn("label", F.when(F.col("doc_id") % 3 > 0, F.col("truth")))
    runs = [trials.ShareRun(i, s, t) for i, (s, t) in enumerate((s, t) for s in (0.3, 0.9) for t in (1, 2))]
    parted = trials.share_roles(rows, runs, "label", 0.5, 0.2, 7, "doc_id").collect()
    unit = lambda *p: hash32(*p) / 2**32
    seen = {r.doc_id: r for r in parted}
    for doc in rows.select("doc_id", "label").collect():
        i = doc.doc_id
        known = [r.run for r in runs if doc.label is not None and unit(i, 7, r.trial) < 0.8 and unit(i, 8, r.trial) < r.share]
        held = [r.run for r in runs if doc.label is not None and unit(i, 7, r.trial) >= 0.8]
        free = [r.run for r in runs if doc.label is None and unit(i, 9, r.trial) < 0.5]
        if known + held + free:
            assert (seen[i].known, seen[i].held, seen[i].used) == (known, held, known + held + free)
        else:
            assert i not in seen


def test_share_trials_equal_single_runs(counted):
    rows = counted.withColumn("label", F.when(F.col("doc_id") % 3 > 0, F.col("truth")))
    settings = em.EMParams(max_epoch=2)
    done, _ = trials.share_trials(rows, PARAMS, (0.5, 0.9), 2, 3, settings, free_share=0.6, test_share=0.3)
    runs = {(r.share, r.trial): r for r in done.collect()}
    assert len(runs) == 4
    parted = trials.share_roles(
        rows, [trials.ShareRun(0, 0.5, 2)], "label", 0.6, 0.3, 3, "doc_id"
    ).drop("truth")
    named = lambda c: parted.where(F.array_contains(c, 0))
    single = em.run_em(
        em.em_rows(named("known"), named("used").where("label IS NULL"), named("held"), PARAMS, "doc_id"), PARAMS, settings
    )
    r = runs[0.5, 2]
    assert r.acc_sup == pytest.approx(single.trace.where("epoch = 1").first().acc_test)
    assert r.acc_em == pytest.approx(em.run_accuracy(named("held").drop("held"), single.model).first().accuracy)
    assert (r.n_labelled, r.n_rows) == (named("known").count(), named("held").count())
    summary = {s.share: s for s in evaluate.trial_summary(done, "share").collect()}
    both = [runs[0.5, t].acc_em for t in (1, 2)]
    assert summary[0.5].mean_em == pytest.approx(statistics.fmean(both))
    assert summary[0.5].sd_em == pytest.approx(statistics.pstdev(both))


@pytest.mark.parametrize("model_type", ["multinomial", "bernoulli"])
def test_joined_scores_of_many_runs_equal_inline_ones(counted, model_type):
    train, test = grid_inputs(counted)
    if model_type == "bernoulli":
        train, test = (d.withColumn("counts", F.transform("counts", lambda x: F.lit(1))) for d in (train, test))
    params = replace(PARAMS, model_type=model_type)
    # run 1 lacks a class
    known = train.select(
        F.explode(F.when(F.col("label") == 0, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("run"), "label", "buckets", "counts"
    )
    model = bayes.Model(bayes.class_cells(known, params), params, (0, 1)).frozen()
    labels = scoring.labels_of(model.cells)
    inline = {r.doc_id: r.raw for r in scoring.with_raw(test, model, labels, "doc_id").collect()}
    joined = {r.doc_id: r.raw for r in scoring.with_raw(test, model, labels, "doc_id", "joined").collect()}
    assert inline.keys() == joined.keys()
    for i in inline:
        assert len(joined[i]) == 2 * len(labels)
        assert joined[i] == pytest.approx(inline[i])


def test_frequent_features_are_bounded(spark):
    rows = spark.range(400).selectExpr("id AS doc_id", "array(7, CAST(100 + id AS INT)) AS buckets", "array(1, 1) AS counts")
    found = scoring.frequent_features(rows, PARAMS).collect()
    copies = {r.bucket: r._copies for r in found}
    assert copies[7] == 4000 and len(found) <= scoring.HOT


@pytest.mark.parametrize("way", ["inline", "joined"])
def test_resumed_em_equals_an_unbroken_one(counted, tmp_path, way):
    train, test = grid_inputs(counted)
    cells = [trials.Cell(0, 2, 1, 0), trials.Cell(1, 9, 1, 0)]
    rows = trials.grid_rows(train, test, trials.known_runs(cells), PARAMS, "doc_id")
    settings = em.EMParams(max_epoch=4, min_improvement=1e-4, way=way)
    whole = em.run_em(rows, PARAMS, settings, runs=(0, 1))
    folder = str(tmp_path / "journal")
    part = em.run_em(rows, PARAMS, settings, runs=(0, 1), journal=folder, stop_after=2)
    assert part.trace.agg(F.max("epoch")).first()[0] == 2
    resumed = em.run_em(rows, PARAMS, settings, runs=(0, 1), journal=folder)
    names = {p.name for p in (tmp_path / "journal" / "runs0").iterdir()}
    assert sum(n.startswith("record") for n in names) == 1 and sum(n.startswith("cells") for n in names) <= 1
    assert resumed.epochs == whole.epochs

    def rounded(result):
        return sorted((r.run, r.epoch, r.acc_test, r.n_label0, round(r.log_prob, 6)) for r in result.trace.collect())

    def cell_values(result):
        return {(r.run, r.label, r.bucket): (round(r.weight, 9), round(r.mass, 9), r.df) for r in result.model.cells.collect()}

    assert rounded(resumed) == rounded(whole) and cell_values(resumed) == cell_values(whole)
    # a third call has nothing left to do, another setting is refused
    again = em.run_em(rows, PARAMS, settings, runs=(0, 1), journal=folder)
    assert rounded(again) == rounded(whole)
    with pytest.raises(ValueError, match="other settings"):
        em.run_em(rows, PARAMS, replace(settings, max_epoch=9), runs=(0, 1), journal=folder)
