import os

import pytest

from strandwork.plans import catalog
from tests.compare import DATA, check

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no data")


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_sql(spark, name):
    check(spark, catalog.queries()[name], catalog.oracle_sql().get(name))


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(catalog.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
