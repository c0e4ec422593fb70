"""Every named query against its SQL on the smallest given tables."""

import pytest
from compare import compare, duck

from __spark_entry__ import entry, oracle_sql, queries

SF_DIR = "/root/testdata/sf0.001"
SQL = oracle_sql()
QUERIES = queries()
SLOW = {"m5_score", "t2_top_features", "m13_importance_table"}  # the same training as m4_train_gbt


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    note = compare(QUERIES[name](spark, SF_DIR), con, SQL[name])
    assert note in (None, "both empty"), note


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert entry(spark).count() == 10


def test_oracle_names_are_queries():
    assert set(SQL) <= set(QUERIES)
