import random
from collections import Counter

import pytest
from pyspark.ml.feature import StringIndexer
from pyspark.sql import functions as F

from labelspring.operators import labels
from labelspring.operators.ranking import rank_within


def test_codes_follow_frequency_then_value(spark):
    df = spark.createDataFrame([(x,) for x in "bbaaccccd"] + [(None,)], "v string")
    got = {r.value: r.label for r in labels.fit_label_index(df, "v").collect()}
    assert got == {"c": 0, "a": 1, "b": 2, "d": 3}
    ml = StringIndexer(inputCol="v", outputCol="l").fit(df.where("v IS NOT NULL"))
    assert list(ml.labels) == sorted(got, key=got.get)


def test_unseen_values(spark):
    codes = labels.fit_label_index(spark.createDataFrame([("a",), ("a",), ("b",)], "v string"), "v")
    new = spark.createDataFrame([("b",), ("z",), (None,)], "v string")
    keep = labels.apply_label_index(new, codes, "v", unseen="keep").collect()
    assert Counter(r.label for r in keep) == {1: 1, 2: 2}
    skip = labels.apply_label_index(new, codes, "v", unseen="skip").collect()
    assert [(r.v, r.label) for r in skip] == [("b", 1)]
    with pytest.raises(Exception, match="without a code"):
        labels.apply_label_index(new, codes, "v").collect()
    with pytest.raises(ValueError):
        labels.apply_label_index(new, codes, "v", unseen="drop")


def test_instance_index_shares_repeated_ids(spark):
    df = spark.createDataFrame(
        [("t", "x"), ("t", "y"), ("t", "y"), ("t", "z"), ("u", "q")], "topic string, id string"
    )
    rows = labels.with_instance_index(df, "topic", "id").collect()
    assert {(r.topic, r.id, r.ind) for r in rows} == {("t", "y", 0), ("t", "x", 1), ("t", "z", 2), ("u", "q", 0)}
    assert len(rows) == 5


def test_rank_is_exact_for_a_dominant_group(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"g{i % 50}", rng.random(), i) for i in range(20000)]
    df = spark.createDataFrame(rows, "g string, x double, i int").repartition(8)
    # several ranges per hot group, as on a cluster
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.i: r.ind for r in rank_within(df, "g", [F.desc("x"), F.asc("i")]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for g in {r[0] for r in rows}:
        members = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        want.update({r[2]: n for n, r in enumerate(members)})
    assert got == want


def test_class_figures(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)], "label int, ind int")
    assert labels.class_count(df).first().n_classes == 2
    assert labels.smallest_class(df).first().min_class == 2
    assert {(r.label, r.max_ind, r.n_rows) for r in labels.topic_profile(df, "label", "ind").collect()} == {(0, 2, 3), (1, 1, 2)}
