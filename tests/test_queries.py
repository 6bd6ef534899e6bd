"""Every registered query against its SQL on the given tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import compare, connect
from ledgerfold.plans.catalogue import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def oracle():
    return connect(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    assert compare(spark, oracle, name, QUERIES[name], ORACLES[name], SF_DIR) is None


def test_entry(spark):
    assert entry(spark).count() > 0
