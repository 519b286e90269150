"""Every registered query of the transit engine against its SQL."""

import pytest

from taktwerk.plans.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, sf, same_rows, name):
    same_rows(QUERIES[name](spark, sf), ORACLE_SQL[name])


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
