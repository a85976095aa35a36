"""Every registered query of the library itself against its SQL twin, over whole small tables."""

import pytest

from loomspan.plans.registry import oracle_sql, queries
from tests.oracle import SMALL, compare, connection


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, con, name):
    compare(spark, queries()[name], oracle_sql()[name], con)


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_runs(spark, name):
    assert queries()[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
