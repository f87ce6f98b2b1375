"""Physical-plan properties that matter at scale."""

import os

from iolens.operators import access
from iolens.sources import views as V

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_block_counts_aggregate_before_shuffle(spark):
    p = plan(access.block_access_counts(V.trace(spark, SF)))
    assert "partial_count" in p
    assert p.index("Exchange") < p.rindex("partial_count")


def test_device_slice_prunes_partitions(spark):
    from iolens.session import scratch_path
    from iolens.sources import readers as R
    from iolens.sources import writers as W
    path = W.split_by_device(V.trace(spark, SF), scratch_path(spark, "plan-split"))
    df = R.load_device_slice(spark, path, 3, 0, 24, base="2024-01-01 00:00:00")
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(device_id" in p and "(device_id#" in p
    assert "PushedFilters" in p and "timestamp" in p.split("PushedFilters")[1][:200]


def test_trace_scan_prunes_columns(spark):
    p = plan(access.block_access_counts(V.trace(spark, SF)))
    schema = p.split("ReadSchema: ")[1].split("\n")[0]
    assert "event_type" not in schema and "ts" not in schema.replace("struct<", "")


def test_multi_bucket_windows_hash_aggregate_and_plain_joins(spark, small_buckets):
    from iolens.operators import reuse
    t = V.trace(spark, SF)
    for df in (reuse.all_reuse_volume(t, V.TRACE_ORDER), reuse.first_reuse_segments(t, V.TRACE_ORDER),
               reuse.first_arrival_rank(t, V.TRACE_ORDER)):
        p = df._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in p and "CartesianProduct" not in p and "NestedLoop" not in p
    # the build side of a keyed join grows with the trace: no forced hash table
    assert "ShuffledHashJoin" not in plan(reuse.reuse_gap_requests(t, V.TRACE_ORDER))


def test_positions_need_no_join_and_no_single_partition(spark, small_buckets):
    from iolens.operators import reuse
    p = plan(reuse.request_sequence(V.trace(spark, SF), V.TRACE_ORDER))
    assert "SinglePartition" not in p and "Join" not in p


def test_lag_in_time_writes_and_numbers_nothing(spark, small_buckets):
    """The trace is read for the stretches and for the result; nothing lies between."""
    from iolens.operators import features, reuse
    t = V.trace(spark, SF)
    for df in (reuse.inter_arrival(t, V.TRACE_ORDER), features.device_features(t, V.TRACE_ORDER), features.window_features(t, V.TRACE_ORDER)):
        p = plan(df)
        assert "events.parquet" in p and "iolens-scratch" not in p and "rangepartitioning" not in p and "SinglePartition" not in p


def records_read(sf, queries, small_bytes=None):
    """Input records of all jobs a query runs, by name, from the event logs of a session of its own."""
    import json
    import subprocess
    import sys
    import tempfile

    logs = tempfile.mkdtemp(prefix="iolens-events-")
    code = f"""
import sys; sys.path.insert(0, {ROOT!r})
from iolens.session import get_session
from iolens.plans import order
from iolens.operators import reuse
from iolens.sources import views as V
if {small_bytes!r} is not None: order.SMALL_BYTES = {small_bytes!r}
spark = get_session("local[2]", 4, extra={{"spark.eventLog.enabled": "true", "spark.eventLog.dir": "file://{logs}", "spark.eventLog.compress": "false",
                                          "spark.eventLog.rolling.enabled": "false"}})
spark.sparkContext.setLogLevel("OFF")
t = V.trace(spark, {sf!r})
for q in {queries!r}:
    spark.sparkContext.setJobGroup(q, q)
    getattr(reuse, q)(t, V.TRACE_ORDER).write.format("noop").mode("overwrite").save()
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, timeout=300)
    group, read = {}, {}
    for f in os.listdir(logs):
        for line in open(os.path.join(logs, f)):
            e = json.loads(line)
            if e["Event"] == "SparkListenerJobStart":
                group |= {s: e["Properties"].get("spark.jobGroup.id") for s in e["Stage IDs"]}
            elif e["Event"] == "SparkListenerTaskEnd":
                q = group.get(e["Stage ID"])
                n = e["Task Metrics"]["Input Metrics"]["Records Read"]
                read[q] = read.get(q, 0) + n
    return read


def test_records_read_from_the_event_log(spark):
    """A small trace is read twice, for its count and for the result; a large one for
    the sample of its ranges and for the shuffle, then the written one for the
    counts of its buckets (one column) and the result."""
    n = spark.read.parquet(f"{SF}/events.parquet").count()
    small = records_read(SF, ["request_sequence", "reuse_gap_requests"])
    assert all(v <= 2 * n for v in small.values()), (n, small)
    large = records_read(SF, ["request_sequence", "reuse_gap_requests"], small_bytes=-1)
    assert all(v <= 4 * n for v in large.values()), (n, large)


def scans(df, table):
    """How often the final plan reads a table of the input."""
    import re

    return len(re.findall(rf"FileScan parquet[^\n]*{table}.parquet", plan(df)))


def test_one_read_of_the_trace(spark, monkeypatch):
    """Bounds, bins and counts come from one written aggregate, not from the trace again."""
    from iolens.operators import cdf, rates, reuse, series, sizes
    from iolens.plans import order
    monkeypatch.setattr(order, "SMALL_BYTES", -1)  # a small trace is one sorted range, which is not written
    t = V.trace(spark, SF)
    o = V.TRACE_ORDER
    for df in (rates.mean_rate_resampled(t), rates.iops_mean_peak(t), rates.busiest_device_rate(t), series.hourly_series_filled(t),
               series.chrono_split(series.hourly_series_filled(t)), sizes.size_cdf_sampled(t), sizes.size_cdf_percent(t),
               reuse.annotate_first_reuse(t, o), cdf.index_cdf(reuse.reuse_gap_requests(t, o), "gap")):
        assert scans(df, "events") == 0  # everything below a written table


def test_a_cell_report_orders_the_grid_once(spark, monkeypatch):
    """Six tables, one ordering; on a large grid all of them read the written one."""
    from iolens.operators import report
    from iolens.plans import order
    from iolens.sources import readers as R
    calls = []
    real = order.assign_buckets

    def counted(df, by, *a, **k):
        calls.append(tuple(by))
        return real(df, by, *a, **k)

    monkeypatch.setattr(order, "SMALL_BYTES", -1)
    monkeypatch.setattr(order, "assign_buckets", counted)
    grid = R.load_device_grid(V.trace(spark, SF), range(8), n_hours=720, base="2024-01-01 00:00:00")
    tables = report.cell_report(grid, V.TRACE_ORDER)
    assert list(tables) == list(report.ANALYSES)
    assert [c for c in calls if "timestamp" in c] == [("slice_start", "device_id", *V.TRACE_ORDER)]
    for name, df in tables.items():
        assert scans(df, "events") == 0, name
