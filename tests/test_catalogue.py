import pytest

from tests.oracle import connect, same_rows
from twinvec.plans import catalogue

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf, name):
    same_rows(catalogue.queries()[name](spark, sf).toPandas(), connect(sf).execute(SQL[name]).fetchdf())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 25 * 10  # every twentieth row asks
    assert set(e.oracle_sql()) <= set(e.queries())
