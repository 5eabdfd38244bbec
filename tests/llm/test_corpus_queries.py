"""The registered corpus queries against their SQL, and their contracts against plain Python."""

import re

import oracle
import pytest

import __spark_entry__ as entry
from undula.llm import queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    got = oracle.spark_table(queries.QUERIES[name](spark, SF_DIR))
    assert oracle.difference(got, oracle.sql_table(oracle.connect(SF_DIR), queries.ORACLES[name])) is None


def test_all_are_registered():
    names = {re.match(r"op\d+_", n)[0] for n in entry.queries() if n.startswith("op")}
    assert names == {f"op{n}_" for n in range(1, 14)} and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_column_types(spark):
    docs = {"doc_id": "bigint"}
    want = {
        "op3_disclosure": docs | {"n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
        "op9_pivotal_mix": docs | {"size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    }
    for name, columns in want.items():
        assert columns.items() <= dict(queries.QUERIES[name](spark, SF_DIR).dtypes).items()
