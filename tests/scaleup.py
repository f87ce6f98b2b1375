"""Scale check (not a test): time order-dependent operators on a larger trace
that Spark derives from the tables -- ``copies`` time-shifted copies of the
dense trace, written once under the checkpoint folder.

python tests/scaleup.py [copies=16] [sf_dir=/root/testdata/sf0.1]
"""

from __future__ import annotations

import os
import sys
import time
from functools import reduce

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from iolens.operators import access, features, reuse  # noqa: E402
from iolens.session import get_session, scratch_path  # noqa: E402
from iolens.sources import views as V  # noqa: E402


def main() -> None:
    copies = int(sys.argv[1]) if len(sys.argv) > 1 else 16
    sf = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.1"
    spark = get_session("local[8]", 32, extra={"spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    base = V.trace_dense(spark, sf)
    span = 3_000_000_000  # shift per copy (us), beyond the dense trace's range
    big = reduce(lambda a, b: a.unionByName(b), [
        base.withColumn("timestamp", F.col("timestamp") + F.lit(k * span)) for k in range(copies)])
    path = scratch_path(spark, "scaleup")
    big.write.parquet(path)
    t = spark.read.parquet(path)
    print("requests", t.count(), flush=True)
    order = V.DENSE_ORDER
    for name, build in [
        ("block_access_counts", lambda: access.block_access_counts(t)),
        ("reuse_gap_requests", lambda: reuse.reuse_gap_requests(t, order, "count")),
        ("all_reuse_volume", lambda: reuse.all_reuse_volume(t, order)),
        ("first_reuse_segments", lambda: reuse.first_reuse_segments(t, order)),
        ("device_features", lambda: features.device_features(t, order)),
    ]:
        t0 = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()  # includes eager bucketing
        print(name, round(time.perf_counter() - t0, 1), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
