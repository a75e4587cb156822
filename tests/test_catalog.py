"""Every query that has SQL gives the rows of its SQL."""

import pytest

from tessera.plans import catalog, files, surfaces  # noqa: F401


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, same, name):
    df = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    if name in catalog.SQL:
        same(df, catalog.SQL[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
