"""Every registered query against its SQL oracle."""

import os

import pytest
from oracle import compare

import __spark_entry__ as entry
from workload.oracles import ORACLES
from workload.queries import QUERIES

DIRS = [f"/root/testdata/sf{sf}" for sf in os.environ.get("TEST_SF", "0.001").split(",")]


def test_each_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_entry_has_all_queries():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 3


@pytest.mark.parametrize("sf_dir", DIRS)
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, name, sf_dir):
    assert compare(QUERIES[name](spark, sf_dir), ORACLES[name], sf_dir) == ""
