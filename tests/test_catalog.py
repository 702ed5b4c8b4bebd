"""Every query over the driver's tables against its SQL."""

import pytest

from chronoweave import catalog
from tests.oracle import SMALL, same_rows


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_as_sql(spark, name):
    same_rows(catalog.QUERIES[name](spark, SMALL), catalog.ORACLE_SQL[name], SMALL)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0


def test_flagship(spark):
    assert catalog.flagship(spark, SMALL).count() > 0
