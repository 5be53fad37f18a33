"""Shape of the physical plans, with no setting to spread small inputs."""

import os
import re

import pytest

from labelspring.catalog import queries as catalog
from labelspring.plans import bayes, scoring

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables missing")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def read_schemas(text: str) -> list[set[str]]:
    found = re.findall(r"ReadSchema: struct<(.*?)>", text)
    return [{c.split(":")[0] for c in f.split(",") if c} for f in found]


def test_counting_terms_needs_no_shuffle(spark):
    text = plan(catalog.hashed_tf(spark, FOLDER))
    assert "Exchange" not in text
    assert read_schemas(text) == [{"doc_id", "text"}]


def test_inline_scoring_needs_no_shuffle(spark):
    text = plan(catalog.nb_predict(spark, FOLDER))
    assert "Exchange" not in text and "ArrowEvalPython" in text
    assert read_schemas(text) == [{"doc_id", "text"}]


def test_fit_shuffles_partial_class_sums_once(spark):
    docs = catalog.documents(spark, FOLDER, "doc_id", "text", "lang")
    cells = bayes.class_cells(
        catalog.counted(docs.withColumnRenamed("lang", "label"), "label"), catalog.PARAMS
    )
    text = plan(cells)
    assert text.count("Exchange hashpartitioning") == 1
    assert text.count("partial_sum") > 0


def test_split_filters_run_below_the_tokenizer(spark):
    rows = catalog.counted(catalog.documents(spark, FOLDER, "doc_id", "text"))
    text = plan(rows.where(catalog.held_back()))
    assert text.index("sort_array") < text.rindex("Filter")


def test_equality_filters_reach_the_scan(spark):
    text = plan(catalog.equality_filter(spark, FOLDER))
    assert re.search(r"PushedFilters: \[.*EqualTo\(quality,0\)", text)
    assert read_schemas(text) == [{"doc_id", "quality"}]


def test_small_codes_are_broadcast(spark):
    assert "BroadcastHashJoin" in plan(catalog.label_index_apply(spark, FOLDER))


def test_joined_scoring_meets_on_salted_features(spark):
    rows = catalog.counted(catalog.documents(spark, FOLDER, "doc_id", "text"))
    model = bayes.fit(catalog.labelled_counts(spark, FOLDER), catalog.PARAMS).frozen()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(scoring.with_raw_joined(rows, model, (0, 1), "doc_id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert re.search(r"Exchange hashpartitioning\(bucket#\d+, _salt#\d+", text)
    assert "CartesianProduct" not in text and "NestedLoop" not in text
