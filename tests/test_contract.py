"""Every core query against its SQL on the smallest data, and the driver's entry."""

import importlib

import pytest

import __spark_entry__ as entry
from tests_data import SMALL

CORE = [m for m in entry.MODULES if ".llm" not in m]
QUERIES = {k: f for m in CORE for k, f in importlib.import_module(m).QUERIES.items()}
SQL = {k: s for m in CORE for k, s in importlib.import_module(m).SQL.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(same, name):
    same(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() >= 1


def test_entry(spark):
    assert entry.entry(spark).count() > 0
