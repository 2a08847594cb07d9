import os

import pytest

import compare
from shelfline.plans import load_registry

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = load_registry()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are missing")


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, con, name):
    ok, n, _, note = compare.check(spark, FOLDER, name, QUERIES[name], ORACLES.get(name), con)
    assert ok, note
    assert n > 0


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as contract

    df = contract.entry(spark)
    assert df.count() > 0 and "sell_through_rate" in df.columns
