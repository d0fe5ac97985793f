"""Every registered query against its SQL on the smallest tables."""

import pytest
from catalog.all import ORACLES, QUERIES

from tests.oracle import compare, database

SF_DIR = "/root/testdata/sf0.001"
# minutes of optimiser steps; the same code is covered by test_training.py
SLOW = {"x_train_step"}


@pytest.fixture(scope="module")
def con():
    return database(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF_DIR), con, ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_query_returns_rows(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    from __spark_entry__ import entry

    assert entry(spark).columns == ["staid", "d", "pred"]
