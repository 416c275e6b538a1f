"""Every query of the library runs, and gives the rows of its SQL."""

import pytest
from compare import assert_same

import sporeline.queries as core

QUERIES, ORACLES = core.queries(), core.oracle_sql()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    assert assert_same(QUERIES[name](spark, sf_dir), duck, ORACLES[name]) > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
