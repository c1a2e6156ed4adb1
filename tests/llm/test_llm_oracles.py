"""Every registered query of the folder that has SQL, against it."""

import os

import duckdb
import oracle
import pytest

from millrace.llm.oracles import ORACLES
from millrace.llm.queries import QUERIES

DIRS = [f"/root/testdata/sf{sf}" for sf in os.environ.get("TEST_SF", "0.001").split(",")]
TABLES = ("documents", "conversations", "benchmark", "labels")


def _duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


@pytest.mark.parametrize("sf_dir", DIRS)
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, monkeypatch, name, sf_dir):
    monkeypatch.setattr(oracle, "duck", _duck)
    assert oracle.compare(QUERIES[name](spark, sf_dir), ORACLES[name], sf_dir) == ""
