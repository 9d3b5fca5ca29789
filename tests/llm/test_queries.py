import os

import pytest

from strandwork.llm import queries
from tests.compare import DATA, check

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA) or not os.path.exists(queries.VOCABULARY), reason="no data")


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_equals_its_sql(spark, name):
    check(spark, queries.queries()[name], queries.oracle_sql().get(name))


def test_every_sql_has_a_query():
    assert set(queries.oracle_sql()) <= set(queries.queries())
