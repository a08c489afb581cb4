import pytest

from marketlake.plans import caches, history, landing, market
from tests.oracle import SF, spark_rows, sql_rows

PLANS = (market, history, landing, caches)
QUERIES, ORACLES = {k: v for p in PLANS for k, v in p.QUERIES.items()}, {k: v for p in PLANS for k, v in p.ORACLES.items()}


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SF)) == sql_rows(ORACLES[name])


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
