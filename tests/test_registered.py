"""Every registered query runs; those with a SQL form agree with it row by row."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from compare import canonical, duck_rows  # noqa: E402


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, small, name):
    df = entry.queries()[name](spark, small)
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    columns, expected = duck_rows(sql, small)
    assert sorted(columns) == sorted(df.columns)
    assert canonical(df.columns, rows) == canonical(columns, expected)


def test_entry(spark):
    assert entry.entry(spark).count() == 10


def test_sql_names_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
