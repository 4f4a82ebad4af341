import pytest

from marginalia.plans import catalogue
from tests.oracle import agree, connect

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, name):
    agree(catalogue.queries()[name](spark, sf_dir), connect(sf_dir), SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    df = catalogue.queries()[name](spark, sf_dir)
    assert df.columns and df.count() > 0
