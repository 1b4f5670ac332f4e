"""Every query with SQL gives the rows of its SQL; the others give rows."""

import pytest
from oracle import connect, differences

from __spark_entry__ import entry, oracle_sql, queries

SLOW = {"model_grid_metrics"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, sf, con, name):
    assert differences(queries()[name](spark, sf), oracle_sql()[name], con) is None


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql()) - SLOW))
def test_query_gives_rows(spark, sf, name):
    assert queries()[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry(spark).columns == ["post_id", "num_offers", "class_offers", "class_views"]
