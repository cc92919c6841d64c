"""Every registered query against DuckDB at the smallest scale."""

from __future__ import annotations

import pytest
from compare import connect, difference

import __spark_entry__ as entry_points
from promptloom.plans import CHECKS, QUERIES

FOLDER = "/root/testdata/sf0.001"
# reports of trouble, empty where the data has none
MAY_BE_EMPTY = {"leakage", "new_paths"}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = entry_points.queries()[name](spark, FOLDER)
    sql = entry_points.oracle_sql()[name]
    if name not in MAY_BE_EMPTY:
        assert not df.isEmpty()
    assert difference(df, con, sql) is None


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["conv_id", "n_tokens", "n_supervised", "truncated"]
    assert df.count() > 0


def test_every_query_has_sql():
    assert set(CHECKS) == set(QUERIES) <= set(entry_points.queries())
