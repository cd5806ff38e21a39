import pytest

import __spark_entry__
from tests.oracle import both, rows
from weftmat.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, name):
    got, want = both(spark, catalog.QUERIES[name], catalog.SQL[name], SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 6000
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
