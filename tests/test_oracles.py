"""Every registered trip query against its SQL on the smallest tables."""

import pytest

from tests.conftest import DATA, rows
from tripmill.plans import catalogue

ORACLES = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    got = catalogue.queries()[name](spark, DATA).toPandas()
    expected = duck.execute(ORACLES[name]).df()
    columns = sorted(expected.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(expected, columns)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
