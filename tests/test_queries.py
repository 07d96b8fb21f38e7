"""Every registered query against its SQL counterpart."""

import pytest

import __spark_entry__ as entry
from workload.check import compare, connect
from workload.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_sql(spark, con, sf_dir, name):
    assert compare(spark, con, sf_dir, name) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert {"RTT", "Country", "GeoLocation", "ASN"} <= set(df.columns)
