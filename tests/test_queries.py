"""Every registered query against its DuckDB twin."""

from __future__ import annotations

import pytest

import __spark_entry__
from checks.compare import rows_of, views
from checks.registry import build
from tests.conftest import SF


@pytest.fixture(scope="module")
def duck():
    return views(SF)


@pytest.mark.parametrize("name", sorted(build()))
def test_query(spark, duck, name):
    query, twin = build()[name]
    ours = query(spark, SF)
    mine = rows_of(ours.columns, ours.collect())
    assert mine or twin
    if twin:
        theirs = duck.sql(twin)
        assert sorted(ours.columns) == sorted(theirs.columns)
        assert mine == rows_of(theirs.columns, theirs.fetchall())


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and {"severity", "type", "found"} == set(rows[0].asDict())
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
