"""Every registered query against its SQL."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from oracles import all_sql
from parity import duck, mismatch
from sessionscope.catalog import build_queries

SF_DIR = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


def test_every_query_has_sql():
    assert set(build_queries()) == set(all_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_query_matches_sql(spark, connection, name):
    difference = mismatch(spark, connection, SF_DIR, entry.queries()[name], entry.oracle_sql()[name])
    assert difference is None, difference


def test_entry_has_rows(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["driver", "metric", "key", "value", "status"]
    assert frame.count() > 40
