"""Every registered query against DuckDB on the small tables."""

import pytest
from conftest import SMALL, same_result

from remitlens.plans import catalog


def test_each_query_has_sql():
    assert catalog.QUERIES.keys() == catalog.ORACLES.keys()
    assert len(catalog.QUERIES) >= 42


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_equal_to_sql(spark, duck, name):
    assert same_result(catalog.QUERIES[name](spark, SMALL), duck, catalog.ORACLES[name])


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 15
    assert catalog.QUERIES.keys() <= __spark_entry__.queries().keys()
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
