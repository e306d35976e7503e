"""Every registered query against the SQL it stands for, over whole tables."""

import os

import pytest
from compare import connect, differences

import __spark_entry__ as entry_points

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = entry_points.queries()
ORACLE = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def oracle():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, oracle, name):
    assert differences(QUERIES[name](spark, FOLDER), oracle, ORACLE[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    row = entry_points.entry(spark).first()
    assert (row.percent_removed, row.retained, row.removed) == (30, 140, 60)
    assert row.retained_mean_score > row.removed_mean_score
