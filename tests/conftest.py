import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))


@pytest.fixture(scope="session")
def spark():
    from iolens.session import get_session
    s = get_session("local[4]", 8, app="iolens-tests", extra={"spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def small_buckets(spark):
    """Force many order buckets so the cross-bucket code paths run."""
    key = "iolens.order.rowsPerBucket"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "7")
    yield
    if old is None:
        spark.conf.unset(key)
    else:
        spark.conf.set(key, old)
