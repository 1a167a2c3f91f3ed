"""Every registered query with SQL gives the rows DuckDB gives."""

import pytest
from conftest import SF, same_rows

from swarf import plans

QUERIES, ORACLE = plans.queries(), plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_agrees_with_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SF), duck, ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and "status" in df.columns
    assert set(e.oracle_sql()) <= set(e.queries())
