"""Every query with a SQL twin gives its rows; those without give some."""

import pytest
from conftest import DATA, canon

from strataforge import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    found = catalog.QUERIES[name](spark, DATA)
    wanted = duck.execute(catalog.ORACLES[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(found.columns) == sorted(columns)
    assert canon(found.columns, [tuple(r) for r in found.collect()]) == canon(columns, wanted.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_flagship(spark):
    assert catalog.QUERIES[catalog.FLAGSHIP](spark, DATA).count() > 0
