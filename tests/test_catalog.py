"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as contract
from labelspring.catalog.queries import QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables missing")


@pytest.fixture(scope="module")
def con():
    pytest.importorskip("duckdb")
    from verify import connect

    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    from verify import compare

    outcome, _, _ = compare(spark, con, name, FOLDER)
    assert outcome.startswith(("ok", "rows only")), outcome


def test_every_query_has_sql():
    assert set(QUERIES) <= set(contract.oracle_sql())


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["doc_id", "prediction"] and df.count() > 0
