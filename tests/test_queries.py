"""Every registered query against its SQL in DuckDB, over whole tables."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as driver
from weftline.plans import ORACLES, QUERIES
from oracle import connect, difference

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    assert difference(df, con, ORACLES[name]) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == ["centre_code", "country_code", "centre_name", "action_code", "blank"]
    assert df.count() > 0
