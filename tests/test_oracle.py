"""Every registered query against its SQL on the smallest tables."""

import pytest

from ripplet.plans import registry
from tests.conftest import SMALL
from tests.oracle import compare, connect

registry.load_all()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, con, name):
    ok, note = compare(spark, con, registry.QUERIES[name], registry.ORACLES[name], SMALL)
    assert ok, note


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql(spark, name):
    assert registry.QUERIES[name](spark, SMALL).count() > 0
