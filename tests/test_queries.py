"""Every query of the library against its DuckDB oracle; those without one are held against plain versions in
test_plain.py. All give rows."""

import pytest

from tabulon import catalog
from tests.oracle import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    if name in catalog.oracle_sql():
        assert not difference(df, catalog.oracle_sql()[name], con)
        assert con.execute(f"SELECT count(*) FROM ({catalog.oracle_sql()[name]})").fetchone()[0] > 0
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
