"""The registered queries of the package against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as contract
from labelspring.llm import catalog

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables missing")


@pytest.fixture(scope="module")
def con():
    pytest.importorskip("duckdb")
    from verify import connect

    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted([*catalog.QUERIES, "pipeline"]))
def test_query_agrees_with_sql(spark, con, name):
    from verify import compare

    outcome, _, _ = compare(spark, con, name, FOLDER)
    assert outcome.startswith(("ok", "rows only")), outcome


def test_names():
    assert set(catalog.SQL) <= set(catalog.QUERIES)
    assert {*catalog.QUERIES, "pipeline"} <= set(contract.queries())
