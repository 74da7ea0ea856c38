"""Every registered query of the library against its SQL oracle at the smallest scale."""

import pytest

from loomwright import catalog

from .compare import assert_same, connect

NAMES = sorted(catalog.oracle_sql())


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, sf, con, name):
    assert_same(catalog.queries()[name](spark, sf), con, catalog.oracle_sql()[name])


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(NAMES)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() == 200 and df.columns == ["doc_id", "item_id", "jaccard_max", "decision"]
