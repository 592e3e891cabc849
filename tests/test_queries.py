import pytest

from tests.oracle import same
from tidelog.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, sf, name):
    same(catalog.QUERIES[name](spark, sf), catalog.ORACLES[name], sf)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_fold_gives_a_row_for_each_event(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() == spark.read.parquet(f"{sf}/events.parquet").count()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
