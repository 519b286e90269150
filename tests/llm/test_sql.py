"""The corpus queries that SQL can express, against it."""

import pytest

from taktwerk.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, sf, same_rows, name):
    same_rows(QUERIES[name](spark, sf), ORACLE_SQL[name])


def test_all_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
