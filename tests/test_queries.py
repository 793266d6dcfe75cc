"""Every registered query with SQL gives the same rows as its SQL, on the smallest test data."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare

ROOT = "/root/testdata/sf0.001"
CORE = [n for n in entry.registry.queries() if n in entry.registry.oracle_sql()]
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test data")


@pytest.mark.parametrize("name", CORE)
def test_same_as_sql(spark, name):
    text, same = compare(spark, ROOT, name, entry.registry.queries()[name], entry.registry.oracle_sql()[name])
    assert same, text


def test_names_and_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns[0] == "query_id"
