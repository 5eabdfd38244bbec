"""Registered queries against their SQL restatements on the smallest tables."""

import oracle
import pytest

import __spark_entry__ as entry
from undula.plans import all_oracles, all_queries

SF_DIR = "/root/testdata/sf0.001"
NAMES = sorted(all_oracles())


@pytest.fixture(scope="module")
def db():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, db, name):
    got = oracle.spark_table(all_queries()[name](spark, SF_DIR))
    assert oracle.difference(got, oracle.sql_table(db, all_oracles()[name])) is None


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 10
