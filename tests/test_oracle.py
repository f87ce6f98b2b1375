"""Every registered query against its DuckDB oracle on the smallest tables,
with tiny order buckets so the two-level paths are exercised."""

import pytest

from iolens.queries import oracle_sql, queries
from oracle import compare, duck

SF = "/root/testdata/sf0.001"
NAMES = sorted(queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.fixture(scope="module")
def buckets(spark):
    spark.conf.set("iolens.order.rowsPerBucket", "150")
    yield
    spark.conf.unset("iolens.order.rowsPerBucket")


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, buckets, name):
    sp = queries()[name](spark, SF).toPandas()
    sql = oracle_sql().get(name)
    if sql is None:
        assert len(sp.columns) > 0
        return
    ok, msg = compare(sp, con.execute(sql).df())
    assert ok, msg


def test_entry_contract(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())
