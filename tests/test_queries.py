"""Every registered query equals its SQL on the smallest test data."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from checks import catalogue
from checks.verify import compare
from tests.conftest import SF

QUERIES, SQL = catalogue.QUERIES, catalogue.SQL


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql())
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == set()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, SQL[name]) == ""


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert [(r.total_entities, r.total_batches, r.success_count) for r in rows] == [(203, 3, 89)]
    assert rows[0].skips == "duplicate_key=84,no_change=30"
