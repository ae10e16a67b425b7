"""Every registered query against its SQL, over whole small tables."""

from __future__ import annotations

import os

import pytest
from check import differences, oracle_connection

import __spark_entry__ as entry
from workload import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def oracle():
    return oracle_connection(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    if name in ORACLES:
        assert differences(spark, oracle, QUERIES[name], ORACLES[name], FOLDER) is None
    else:
        assert QUERIES[name](spark, FOLDER).columns


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
