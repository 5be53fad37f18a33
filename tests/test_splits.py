import pytest
from hypothesis import given
from hypothesis import strategies as st

from labelspring.operators import splits


def test_sides_are_disjoint_and_complete(spark):
    df = spark.range(2000).withColumnRenamed("id", "doc_id")
    sides = [s.collect() for s in splits.hash_split(df, "doc_id", [7, 2, 1], 5)]
    ids = [r.doc_id for s in sides for r in s]
    assert sorted(ids) == list(range(2000))
    assert all(abs(len(s) / 2000 - w) < 0.05 for s, w in zip(sides, (0.7, 0.2, 0.1)))
    again = [s.collect() for s in splits.hash_split(df.repartition(7), "doc_id", [7, 2, 1], 5)]
    assert [{r.doc_id for r in s} for s in sides] == [{r.doc_id for r in s} for s in again]


def test_bad_weights():
    for weights in ([0, 0], [1, -1]):
        with pytest.raises(ValueError):
            splits._bounds(weights)


def test_random_split_is_complete(spark):
    parts = splits.random_split(spark.range(500), [9, 1], 3)
    assert sorted(r.id for p in parts for r in p.collect()) == list(range(500))


@given(st.integers(1, 2000), st.integers(1, 600), st.integers(0, 5), st.integers(1, 20))
def test_window_fits_the_smallest_class(min_class, n_sup, seed, trial):
    start = splits.window_offset(min_class, n_sup, seed, trial)
    assert 0 <= start
    if min_class <= n_sup:
        assert start == 0
    else:
        assert start + n_sup <= min_class


def test_balanced_split(spark):
    df = spark.createDataFrame(
        [(c, i, [1.0]) for c in (0, 1, 2) for i in range(10)], "label int, ind int, weight array<double>"
    )
    labelled, rest = splits.balanced_split(df, 4, 3)
    assert {(r["label"], r["count"]) for r in labelled.groupBy("label").count().collect()} == {(0, 3), (1, 3), (2, 3)}
    assert rest.columns == ["ind"] and rest.count() == 21


def test_stratified_split_keeps_every_row_once(spark):
    df = spark.createDataFrame([(i, i % 4) for i in range(1000)], "doc_id int, label int")
    sides = splits.stratified_split(df, "doc_id", "label", [1, 1], 9)
    assert sorted(r.doc_id for s in sides for r in s.collect()) == list(range(1000))
    binary = splits.stratified_split(df, "doc_id", "label", [1, 1], 9, labels=[0, 1])
    assert sum(s.count() for s in binary) == 500


def test_strata_fractions(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(3000)], "doc_id int, label int")
    sided = splits.with_strata_side(df, "doc_id", "label", {0: 1.0, 1: 0.3}, 1)
    counts = {(r.label, r.side): r["count"] for r in sided.groupBy("label", "side").count().collect()}
    assert counts[(0, 0)] == 1000 and (2, 0) not in counts
    assert abs(counts[(1, 0)] / 1000 - 0.3) < 0.05


def test_sweep_sets_are_nested(spark):
    df = spark.range(1000).withColumnRenamed("id", "doc_id")
    sets = {}
    for r in splits.size_sweep(df, "doc_id", [100, 400, 1000], 1000, 2).collect():
        sets.setdefault(r.n_sup, set()).add(r.doc_id)
    assert sets[100] < sets[400] < sets[1000] == set(range(1000))
