"""Every query with an oracle returns the oracle's rows."""

import pytest

from marlstone import catalog

from .oracle import FOLDER, compare, connect


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_equals_oracle(spark, con, name):
    df = catalog.queries()[name](spark, FOLDER)
    if name in catalog.oracle_sql():
        compare(df, con, catalog.oracle_sql()[name])
    else:
        df.count()


def test_flagship(spark):
    assert catalog.flagship(spark, FOLDER).count() > 0


def test_names_need_no_session():
    assert len(catalog.queries()) > 300 and set(catalog.oracle_sql()) <= set(catalog.queries())
