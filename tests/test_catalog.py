"""Every named query against its SQL twin."""

import pytest

from millrace.plans import catalog


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(name, spark, sf_dir, same):
    df = catalog.QUERIES[name](spark, sf_dir)
    if name in catalog.ORACLE_SQL:
        same(df, catalog.ORACLE_SQL[name])
    else:
        assert df.count() > 0


def test_entry_module_lists_them(spark):
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
