import pytest

from gradeloom.plans import catalog
from tests.conftest import SF, assert_same

#: Queries that SQL does not express.
ROWS_ONLY = sorted(catalog.queries().keys() - catalog.oracle_sql().keys())


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    assert_same(catalog.queries()[name](spark, SF), duck, catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_query_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["doc_id", "total", "pct", "flagged", "band"]
    assert entry.queries().keys() >= catalog.queries().keys() >= catalog.oracle_sql().keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()
