"""Every registered query against its DuckDB statement on the smallest tables."""

from __future__ import annotations

import pytest
from check import DATA, check, duck

import __spark_entry__ as entry

SF = f"{DATA}/sf0.001"
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_oracles_belong_to_queries():
    assert set(ORACLE) <= set(entry.queries())


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    problem, rows, _ = check(spark, con, SF, name, entry.queries()[name], ORACLE.get(name))
    assert problem == ""
    assert rows > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
