"""Every registered query against its SQL text on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect
from quantgrid.plans import load

SF = "/root/testdata/sf0.001"
MAY_BE_EMPTY: set[str] = set()
"""Queries whose result has no rows on the smallest tables (one supplier per industry, few suppliers)."""
QUERIES, SQL = load().QUERIES, load().ORACLES
BEYOND_SQL = {"score_embeddings_wide"}
"""Checked against NumPy in a test of their own."""


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert not set(SQL) - set(QUERIES)
    assert set(QUERIES) == set(SQL) | BEYOND_SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    err, _ = compare(spark, con, SF, QUERIES[name], SQL[name])
    assert err is None or (err == "no rows at all" and name in MAY_BE_EMPTY), err


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["date_idx", "rank_ic"] and df.count() == 30
