"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare_sql import compare, connect

import __spark_entry__ as entry
from duelframe import catalog

CHECKS, QUERIES = catalog.CHECKS, catalog.QUERIES  # the text operators' queries have their own tests
SLOW = {"margin_model_errors", "season_table", "kalman_parameter_grid", "full_history_models"}  # a minute to some minutes each


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(set(CHECKS) - SLOW))
def test_query_matches_sql(spark, con, sf_dir, name):
    text, ok = compare(spark, con, name, QUERIES[name], CHECKS[name], sf_dir)
    assert ok, text


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKS) - SLOW))
def test_query_runs(spark, con, sf_dir, name):
    text, ok = compare(spark, con, name, QUERIES[name], None, sf_dir)
    assert ok and "rows=0 " not in text, text


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
