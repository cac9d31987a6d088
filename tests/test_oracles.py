"""Registered queries against their SQL, and the driver's contract."""

from __future__ import annotations

import pytest

import __spark_entry__ as registry
from compare import assert_same, tables

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert_same(registry.queries()[name](spark, sf_dir).toPandas(), tables(sf_dir).execute(SQL[name]).df())


def test_every_sql_has_a_query():
    assert set(SQL) <= set(registry.queries())


def test_entry_has_rows(spark, sf_dir):
    assert registry.entry(spark).limit(5).count() == 5
