"""Every query of the core: against its SQL where there is one, else that it gives rows of a stable schema."""

import pytest

from hanmaru.plans import catalogue
from tests.oracle import connect, rows_of_spark, rows_of_sql


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, small, con, name):
    df = catalogue.QUERIES[name](spark, small)
    if name in catalogue.SQL:
        names, got = rows_of_spark(df)
        wanted_names, wanted = rows_of_sql(con, catalogue.SQL[name])
        assert names == wanted_names
        assert got == wanted
    else:
        assert df.columns
        assert df.count() > 0


def test_sql_is_of_known_queries():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)


def test_entry(spark, small):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
