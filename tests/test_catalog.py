"""Every query with an oracle gives the oracle's rows."""

import pytest

import __spark_entry__ as entry

ORACLES = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n in ORACLES and not n.startswith("op")))
def test_query_equals_oracle(spark, sf_dir, duck, same_rows, name):
    same_rows(QUERIES[name](spark, sf_dir), duck.sql(ORACLES[name]))


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in ORACLES and not n.startswith("op") and n != "pipeline"))
def test_query_without_oracle_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() >= 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
