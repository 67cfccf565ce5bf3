import pytest

import __spark_entry__ as entry
from tests.oracle import same

QUERIES, SQL = entry.queries(), entry.oracle_sql()
CORE = [n for n, q in QUERIES.items() if ".llm." not in q.__module__]


@pytest.mark.parametrize("name", [n for n in CORE if n in SQL])
def test_query_equals_sql(spark, data, name):
    same(spark, data, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", [n for n in CORE if n not in SQL])
def test_query_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() >= 0


def test_entry_has_rows(spark, data):
    assert entry.entry(spark).limit(1).count() == 1
