"""Every registered query of the engine against its SQL."""

import pytest
from tests.oracle import SF_DIR, same

from sourcelens.plans import catalog

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, name):
    assert same(catalog.queries()[name](spark, SF_DIR), SQL[name]) > 0


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_has_rows(spark, name):
    assert catalog.queries()[name](spark, SF_DIR).count() > 0
