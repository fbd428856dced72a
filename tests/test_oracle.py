"""Every registered query against its SQL."""

import pytest

from ledgerlens.plans.catalog import QUERIES
from oracle.check import connect, differences
from oracle.sql import ORACLES


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


def test_sql_covers_the_queries():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, data, con, name):
    assert differences(QUERIES[name](spark, data), con, ORACLES[name]) is None


def test_entry_gives_one_context_per_conversation(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["conv_id", "route", "context"]
    assert df.count() == 20
