import pytest
from oracle import assert_same

from tessera import catalogue


@pytest.mark.parametrize("name", list(catalogue.ORACLE_SQL))
def test_same_as_sql(spark, sf, name):
    assert_same(spark, sf, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES.keys() - catalogue.ORACLE_SQL.keys()))
def test_runs(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_entry(spark, sf):
    assert 0 < catalogue.entry(spark, sf).count() <= 10
