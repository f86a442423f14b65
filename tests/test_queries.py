"""Every registered query against its SQL; the others against their own rules."""

import os

import pytest

import __spark_entry__ as contract
from sqlgauge.plans import catalogue
from tests.compare import connect, difference

FOLDER = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
# the training-data operators have tests of their own
QUERIES = {n: q for n, q in contract.queries().items() if n in catalogue.queries()}
SQL = {n: sql for n, sql in contract.oracle_sql().items() if n in QUERIES}
UNCHECKED = {"prepared_samples"}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_is_checked():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == UNCHECKED


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert difference(spark, con, QUERIES[name], SQL[name], FOLDER) is None


@pytest.mark.parametrize("name", sorted(UNCHECKED))
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert df.count() > 0


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert [r["level"] for r in rows] == ["simple", "moderate", "challenging", "total"]
    assert rows[-1]["count"] == 8
