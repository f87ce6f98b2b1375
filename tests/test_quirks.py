"""Hand-made frames, one per documented convention (answers written out)."""

import pytest
from pyspark.sql import functions as F

from iolens.functions import blocks as B
from iolens.operators import access, cdf, features, rates, reuse, sizes

ORDER = ("timestamp", "tie")
COLS = "device_id int, opcode string, offset long, length int, timestamp long, tie long"


def trace(spark, rows):
    return spark.createDataFrame(rows, COLS)


def blocks_of(spark, offset, length, mode):
    df = trace(spark, [(0, "R", offset, length, 0, 0)])
    return sorted(r.block for r in B.explode_blocks(df, mode).collect())


@pytest.mark.parametrize("offset,length,expect", [
    (2048, 4096, {"count": [0], "floor": [0], "cover": [0, 1]}),
    (1024, 512, {"count": [0], "floor": [], "cover": [0]}),
])
def test_block_modes(spark, offset, length, expect):
    for mode, blocks in expect.items():
        assert blocks_of(spark, offset, length, mode) == blocks, mode


def _one_reuse(spark, rows):
    df = trace(spark, rows)
    vol = reuse.all_reuse_volume(df, ORDER).filter((F.col("block") == 0)).collect()
    gap = reuse.reuse_gap_requests(df, ORDER, "cover").filter(F.col("block") == 0).collect()
    return [r.distance for r in vol], [r.gap for r in gap]


def test_adjacent_reaccess(spark):
    assert _one_reuse(spark, [(0, "R", 0, 4096, 1, 1), (0, "R", 0, 4096, 2, 2)]) == ([-1], [1])


def test_one_request_between(spark):
    rows = [(0, "R", 0, 4096, 1, 1), (0, "R", 5 * 4096, 8192, 2, 2), (0, "R", 0, 4096, 3, 3)]
    assert _one_reuse(spark, rows) == ([1], [2])


def test_other_op_between(spark):
    rows = [(0, "R", 0, 4096, 1, 1), (0, "W", 5 * 4096, 4096, 2, 2), (0, "R", 0, 4096, 3, 3)]
    assert _one_reuse(spark, rows) == ([-1], [2])


def test_single_row_features(spark):
    df = trace(spark, [(3, "R", 0, 4096, 10, 1)])
    f = features.device_features(df, ORDER).collect()[0]
    assert f.io_size_std == 0.0 and f.response_time_avg == 0.0 and f.response_time_std == 0.0
    w = features.window_features(df, ORDER).collect()[0]
    assert w.interval_std == 0.0 and w.io_size_std == 0.0


def test_cdf_single_value(spark):
    df = spark.createDataFrame([(7,)], "x long")
    p = cdf.percent_cdf(df, "x").collect()[0]
    assert (p.pct_first, p.pct_last) == (0.0, 0.0)
    i = cdf.index_cdf(df, "x").collect()[0]
    assert i.cdf_first == 0.0
    j = cdf.index_cdf(df, "x", one_based=True).collect()[0]
    assert j.cdf_last == 1.0


def test_empty_bin_is_null(spark):
    df = trace(spark, [(0, "R", 0, 512, 0, 1), (0, "R", 0, 512, 120_000_000, 2)])
    rows = sorted(rates.iops_mean_peak(df, 60).collect(), key=lambda r: r.bin_start)
    assert [r.bin_start for r in rows] == [0, 60_000_000, 120_000_000]
    assert rows[1].mean_iops is None and rows[1].peak_iops is None
    assert rows[0].mean_iops == 1.0 and rows[2].peak_iops == 1


def test_busiest_tie_takes_lowest_id(spark):
    df = trace(spark, [(5, "R", 0, 512, 1, 1), (2, "R", 0, 512, 2, 2)])
    assert {r.device_id for r in rates.busiest_device_rate(df).collect()} == {2}


def test_missing_op_has_no_row(spark):
    df = trace(spark, [(0, "R", 0, 512, 1, 1), (0, "R", 0, 1024, 2, 2)])
    assert [r.opcode for r in sizes.size_p99(df).collect()] == ["R"]


def test_log_histogram_keeps_maximum(spark):
    rows = []
    t = 0
    for blk, cnt in enumerate([1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 97]):
        for _ in range(cnt):
            t += 1
            rows.append((0, "R", blk * 4096, 4096, t, t))
    counts = access.block_access_counts(trace(spark, rows))
    h = access.access_histogram_log(counts).collect()
    assert len(h) == 16 and sum(r.blocks for r in h) == 11
    assert max(h, key=lambda r: r.bin).blocks >= 1


def test_no_reuse_is_empty(spark):
    df = trace(spark, [(0, "R", i * 4096, 4096, i, i) for i in range(5)])
    assert reuse.all_reuse_volume(df, ORDER).count() == 0
    assert reuse.reuse_gap_requests(df, ORDER).count() == 0


def test_time_unit_rejected():
    from iolens.functions.time import unit_micros
    with pytest.raises(ValueError):
        unit_micros("fortnight")


def test_grid_border_row_in_both_slices(spark):
    from iolens.sources.readers import load_device_grid, to_micros
    t0 = to_micros("2020-01-01 00:00:00")
    df = trace(spark, [(1, "R", 0, 512, t0 + 2 * 3_600_000_000, 1)]).drop("tie")
    got = sorted(r.slice_start for r in load_device_grid(df, [1], n_hours=6).collect())
    assert got == [t0, t0 + 2 * 3_600_000_000]


def test_reuse_histogram_integer_bins(spark):
    df = spark.createDataFrame([(g,) for g in [1, 1, 2, 50, 100]], "gap long")
    h = {r.bin: r.n for r in reuse.reuse_histogram(df, "gap").collect()}
    assert len(h) == 50 and sum(h.values()) == 5
    # (x - 1) * 50 div 99: 1 -> 0, 2 -> 0, 50 -> 24, 100 -> last bin (closed)
    assert h[0] == 3 and h[24] == 1 and h[49] == 1


def test_reuse_histogram_single_value(spark):
    df = spark.createDataFrame([(7,), (7,)], "gap long")
    h = {r.bin: r.n for r in reuse.reuse_histogram(df, "gap").collect()}
    assert h[0] == 2 and sum(h.values()) == 2


def test_reuse_stats_median_interpolates(spark):
    df = spark.createDataFrame([("R", 1), ("R", 2), ("R", 10), ("R", 11), ("W", 5)], "opcode string, distance long")
    r = {x.opcode: x for x in reuse.reuse_stats(df).collect()}
    assert r["R"].median_distance == 6.0 and r["R"].mean_distance == 6.0 and r["W"].median_distance == 5.0
    assert (r["R"].min_distance, r["R"].max_distance, r["R"].reuse_count) == (1, 11, 4)


@pytest.mark.parametrize("span", [0, 40, 70_000, 1 << 40])
def test_quantiles_by_radix_selection_are_the_sorted_lists(spark, span):
    import random

    import numpy as np
    from iolens.operators import cdf as C
    rnd = random.Random(span)
    rows = [(rnd.choice(["R", "W", None]), rnd.randint(-span // 2, span)) for _ in range(400)] + [("one", 3), ("none", None)]
    df = spark.createDataFrame(rows, "opcode string, v long")
    by = {op: sorted(v for o, v in rows if o == op and v is not None) for op in {o for o, _ in rows}}
    hist = C.histogram_of(df, "v", ["opcode"])
    for q in (0.0, 0.5, 0.99, 1.0):
        got = {r.opcode: r.quantile for r in C.histogram_quantile(hist, q, ["opcode"]).collect()}
        assert got == {op: pytest.approx(np.percentile(v, 100 * q)) for op, v in by.items() if v}
    every = sorted(v for _, v in rows if v is not None)
    got = C.histogram_quantile(C.histogram_of(df, "v"), 0.5, out="m").collect()
    assert [r.m for r in got] == [pytest.approx(np.percentile(every, 50))]
    empty = C.histogram_quantile(C.histogram_of(df.filter("v is null and v = 1"), "v", ["opcode"]), 0.5, ["opcode"])
    assert empty.count() == 0


def test_reuse_stats_of_long_distances(spark):
    df = spark.range(4000).selectExpr("'R' as opcode", "10000000000000000 as distance")
    r = reuse.reuse_stats(df).collect()[0]
    assert r.reuse_count == 4000 and r.mean_distance == 1e16 and r.median_distance == 1e16


@pytest.mark.parametrize("rows_per_bucket", ["7", "64", "100000"])
def test_nulls_keep_their_rows_at_any_size(spark, rows_per_bucket):
    key = "iolens.order.rowsPerBucket"
    rows = [(i % 3, None if i % 2 else "R", (i % 5) * 4096, 4096, None if i % 10 == 0 else i, i) for i in range(100)]
    df = trace(spark, rows)
    old = spark.conf.get(key, None)
    spark.conf.set(key, rows_per_bucket)
    try:
        seq = {r.tie: r.seq for r in reuse.request_sequence(df, ORDER).collect()}
        w7 = reuse.all_reuse_volume(df, ORDER).count()
        w10 = reuse.inter_arrival(df, ORDER).count()
    finally:
        spark.conf.set(key, old) if old else spark.conf.unset(key)
    want = sorted(rows, key=lambda r: (r[4] is not None, r[4] or 0, r[5]))
    assert seq == {r[5]: k for k, r in enumerate(want)}
    seen, again = set(), 0
    for r in want:
        again += (r[1], r[0], r[2]) in seen
        seen.add((r[1], r[0], r[2]))
    assert w7 == again and w10 == 100


def test_positions_restart_in_each_cell(spark, small_buckets):
    rows = [(d, "R", (k % 4) * 4096, 4096, k, k) for k in range(40) for d in (1, 2)]
    got = reuse.request_sequence(trace(spark, rows), ORDER, keys=["device_id"]).collect()
    assert sorted((r.device_id, r.timestamp, r.seq) for r in got) == sorted((d, k, k) for k in range(40) for d in (1, 2))
