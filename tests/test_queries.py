"""Every registered query against its SQL on the smallest test data."""

from __future__ import annotations

import os

import pytest
from compare import connect, spark_rows, sql_rows

import __spark_entry__ as contract

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test data is not here")


@pytest.fixture(scope="module")
def sql():
    return connect(DATA)


@pytest.mark.parametrize("name", list(contract.queries()))
def test_query(spark, sql, name):
    columns, found = spark_rows(contract.queries()[name](spark, DATA))
    oracle = contract.oracle_sql().get(name)
    if oracle is None:
        assert found
        return
    expected_columns, expected = sql_rows(sql, oracle)
    assert columns == expected_columns
    assert len(found) == len(expected) > 0
    assert found == expected


@pytest.mark.parametrize("name", ["raw_ingest", "silver_stream_sales"])
def test_rows_do_not_depend_on_the_number_of_batches(spark, name):
    query = contract.queries()[name]
    found = [spark_rows(query(spark, DATA, batches)) for batches in (1, 20)]
    assert found[0] == found[1]


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())
