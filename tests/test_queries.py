"""Every named query against its SQL counterpart on the smallest tables."""

import pytest
from compare import connect, differences

from tidemark.plans import REGISTRY


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_equals_sql(spark, con, data, name):
    assert differences(spark, con, REGISTRY[name], data) == ""


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
