"""The SQL that checks the operators, on the driver's small tables."""

import pytest

from chronoweave.llm import queries
from tests.oracle import SMALL, same_rows


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    same_rows(queries.QUERIES[name](spark, SMALL), queries.ORACLE_SQL[name], SMALL)
