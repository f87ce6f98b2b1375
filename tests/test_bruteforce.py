"""Order-dependent operators against plain loops on seeded random traces.

Traces include a hot block (a third of the requests) and a hot timestamp
(many requests in one microsecond), and run with tiny order buckets, so the
split/salted paths are checked, not only the single-bucket one.
"""

import random

import pytest

from iolens.operators import reuse
from iolens.plans.order import global_index

ORDER = ("timestamp", "tie")
COLS = "device_id int, opcode string, offset long, length int, timestamp long, tie long"
B = 4096


def make_trace(seed, n=400):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        dev = rnd.choice([0, 0, 0, 1, 2])
        if rnd.random() < 0.33:
            off = 0  # hot block 0
        else:
            off = rnd.randrange(0, 40) * 1024
        ln = rnd.choice([512, 1024, 4096, 6144, 9000])
        ts = 1000 if i % 5 == 0 else rnd.randrange(0, 5000)  # a hot timestamp
        rows.append((dev, rnd.choice("RW"), off, ln, ts, i))
    return rows


def ordered(rows):
    return sorted(rows, key=lambda r: (r[4], r[5]))


def blocks(off, ln, mode):
    s = off // B
    last = {"count": s + (ln + B - 1) // B - 1, "floor": (off + ln) // B - 1,
            "cover": (off + ln + B - 1) // B - 1, "first": s}[mode]
    return range(s, last + 1)


@pytest.mark.parametrize("seed", [1, 2])
def test_sequence(spark, small_buckets, seed):
    rows = make_trace(seed)
    df = spark.createDataFrame(rows, COLS)
    got = {r.tie: r.seq for r in global_index(df, ORDER).df.collect()}
    assert got == {r[5]: i for i, r in enumerate(ordered(rows))}


@pytest.mark.parametrize("seed", [3, 4])
def test_gap_count_mode(spark, small_buckets, seed):
    rows = make_trace(seed)
    last, want = {}, []
    for i, r in enumerate(ordered(rows)):
        for b in blocks(r[2], r[3], "count"):
            k = (r[0], b)
            if k in last:
                want.append((r[0], b, i, i - last[k]))
            last[k] = i
    df = spark.createDataFrame(rows, COLS)
    got = [tuple(x) for x in reuse.reuse_gap_requests(df, ORDER, "count").collect()]
    assert sorted(got) == sorted(want)


def volume_loop(rows, access=None):
    rows = ordered(rows)
    last, seen, out = {}, {}, []
    for i, r in enumerate(rows):
        for b in blocks(r[2], r[3], "floor"):
            k = (r[1], r[0], b)
            seen[k] = seen.get(k, 0) + 1
            if k in last and (access is None or seen[k] == access):
                between = sum(x[3] for x in rows[last[k] + 1:i] if x[1] == r[1])
                out.append((r[1], r[0], b, i, (between - B) // B))
            last[k] = i
    return sorted(out)


@pytest.mark.parametrize("seed", [5, 6])
def test_volume_all_and_first(spark, small_buckets, seed):
    rows = make_trace(seed)
    df = spark.createDataFrame(rows, COLS)
    assert sorted(tuple(x) for x in reuse.all_reuse_volume(df, ORDER).collect()) == volume_loop(rows)
    assert sorted(tuple(x) for x in reuse.first_reuse_volume(df, ORDER).collect()) == volume_loop(rows, 2)
    assert sorted(tuple(x) for x in reuse.first_reuse_volume(df, ORDER, access=3).collect()) == \
        volume_loop(rows, 3)


@pytest.mark.parametrize("seed", [7])
def test_segments(spark, small_buckets, seed):
    rows = ordered(make_trace(seed))
    last, counted, between, want = {"R": set(), "W": set()}, {"R": set(), "W": set()}, \
        {"R": set(), "W": set()}, []
    for i, r in enumerate(rows):
        op, k = r[1], (r[0], r[2] // B)
        if k in last[op] and k not in counted[op]:
            want.append((op, i, r[0], r[2] // B, len(between[op])))
            counted[op].add(k)
            between[op] = set()
        else:
            between[op].add(k)
        last[op].add(k)
    df = spark.createDataFrame(rows, COLS)
    got = sorted(tuple(x) for x in reuse.first_reuse_segments(df, ORDER).collect())
    assert got == sorted(want)


@pytest.mark.parametrize("seed", [8])
def test_first_arrival_and_inter_arrival(spark, small_buckets, seed):
    rows = ordered(make_trace(seed))
    ids = {}
    for r in rows:
        for b in blocks(r[2], r[3], "cover"):
            ids.setdefault((r[0], b), len(ids))
    df = spark.createDataFrame(rows, COLS)
    got = {(x.device_id, x.block): x.rank for x in reuse.first_arrival_rank(df, ORDER).collect()}
    assert got == ids
    prev, want = {}, {}
    for r in rows:
        want[r[5]] = r[4] - prev[r[0]] if r[0] in prev else 0
        prev[r[0]] = r[4]
    got = {x.tie: x.inter_arrival for x in reuse.inter_arrival(df, ORDER).collect()}
    assert got == want


def test_hot_timestamp_gets_split(spark, small_buckets):
    from iolens.plans.order import BKT, assign_buckets
    rows = [(0, "R", 0, 512, 5, i) for i in range(60)] + [(0, "R", 0, 512, t, 100 + t) for t in range(40)]
    o = assign_buckets(spark.createDataFrame(rows, COLS), ORDER)
    sizes = [r["count"] for r in o.df.groupBy(BKT).count().collect()]
    assert max(sizes) < 40, sizes


def unique_loop(rows, first_only=False):
    rows = ordered(rows)
    acc = []  # (op, dev, block, seq)
    for i, r in enumerate(rows):
        for b in blocks(r[2], r[3], "cover"):
            acc.append((r[1], r[0], b, i))
    last, seen, out = {}, {}, []
    for op, dev, b, i in acc:
        k = (op, dev, b)
        seen[k] = seen.get(k, 0) + 1
        if k in last and (not first_only or seen[k] == 2):
            p = last[k]
            d = len({(x[1], x[2]) for x in acc if x[0] == op and p < x[3] < i})
            out.append((op, dev, b, i, d))
        last[k] = i
    return sorted(out)


@pytest.mark.parametrize("seed,first", [(9, False), (10, True)])
def test_unique_distance(spark, small_buckets, seed, first):
    from iolens.operators.unique_distance import unique_reuse_distance
    rows = make_trace(seed, 250)
    df = spark.createDataFrame(rows, COLS)
    got = sorted(tuple(x) for x in unique_reuse_distance(df, ORDER, first_only=first).collect())
    assert got == unique_loop(rows, first)


@pytest.mark.parametrize("seed,first,rows_per_bucket", [(11, False, "7"), (12, True, "30"), (13, False, "100000")])
def test_unique_distance_in_cells(spark, seed, first, rows_per_bucket):
    from iolens.operators.unique_distance import unique_reuse_distance
    key = "iolens.order.rowsPerBucket"
    rows = make_trace(seed, 260)
    rows = [(None if r[0] == 2 else r[0], *r[1:]) for r in rows]  # a null key is a cell, and a device, of its own
    old = spark.conf.get(key, None)
    spark.conf.set(key, rows_per_bucket)
    try:
        got = unique_reuse_distance(spark.createDataFrame(rows, COLS), ORDER, first_only=first, keys=["device_id"]).collect()
    finally:
        spark.conf.set(key, old) if old else spark.conf.unset(key)
    want = [x for d in (0, 1, None) for x in unique_loop([r for r in rows if r[0] == d], first)]
    assert sorted((r.opcode, str(r.device_id), r.block, r.seq, r.distance) for r in got) == sorted((x[0], str(x[1]), *x[2:]) for x in want)


def test_count_below_is_the_plain_count():
    import numpy as np
    from iolens.operators.unique_distance import count_below
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 7, 64, 300):
        rank = rng.permutation(n)
        upto, below = rng.integers(0, n + 1, 50), rng.integers(0, n + 1, 50)
        assert count_below(rank, upto, below).tolist() == [int((rank[:u] < b).sum()) for u, b in zip(upto, below)]


def test_unique_distance_of_one_hot_block(spark, small_buckets):
    """A block that half of all requests touch is one carry row a range."""
    from iolens.operators.unique_distance import unique_reuse_distance
    rows = [(0, "R", 0 if i % 2 else (i % 14) * B, 512, i, i) for i in range(200)]
    got = sorted(tuple(x) for x in unique_reuse_distance(spark.createDataFrame(rows, COLS), ORDER).collect())
    assert got == unique_loop(rows)


def test_accesses_of_a_hot_block_meet_its_rank_in_many_keys(spark, small_buckets):
    from iolens.operators import access
    from pyspark.sql import functions as F
    rows = [(0, "R", 0 if i % 2 else (i % 50) * B, 512, i, i) for i in range(400)] + [(1, "W", 0, 512, None, 900 + i) for i in range(5)]
    df = spark.createDataFrame(rows, COLS)
    got = access.access_arrival(df, reuse.first_arrival_rank(df, ORDER))
    ids, want = {}, []
    for r in sorted(rows, key=lambda r: (r[4] is not None, r[4] or 0, r[5])):
        want.append((r[4], r[0], r[2] // B, ids.setdefault((r[0], r[2] // B), len(ids))))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    from iolens.plans.order import BKT, time_buckets
    hot = time_buckets(df.filter("offset = 0 and device_id = 0"), "timestamp").df.groupBy(BKT).agg(F.count("*").alias("n")).collect()
    assert len(hot) > 10 and max(r.n for r in hot) < 60  # half of all accesses, spread


@pytest.mark.parametrize("rows_per_bucket", ["5", "50", "100000"])
def test_a_large_input_is_dealt_again_only_where_needed(spark, monkeypatch, rows_per_bucket):
    """The path of inputs that are not small: sampled ranges, counts from the written table."""
    from iolens.plans import order as O
    monkeypatch.setattr(O, "SMALL_BYTES", -1)
    key = O.CONF_ROWS_PER_BUCKET
    rows = make_trace(14)
    old = spark.conf.get(key, None)
    spark.conf.set(key, rows_per_bucket)
    try:
        df = spark.createDataFrame(rows, COLS)
        o = O.global_index(df, ORDER)
        assert {r.tie: r.seq for r in o.df.collect()} == {r[5]: i for i, r in enumerate(ordered(rows))}
        assert o.n == len(rows) and o.nb == o.df.select(O.BKT).distinct().count()
        assert sorted(tuple(x) for x in reuse.all_reuse_volume(df, ORDER).collect()) == volume_loop(rows)
    finally:
        spark.conf.set(key, old) if old else spark.conf.unset(key)


def test_lag_in_time_across_stretches_without_rows(spark, small_buckets):
    rows = [(d, "R", 0, 512, t, i) for i, (d, t) in enumerate([(0, 0), (0, 5), (0, 10_000), (1, 4), (1, None), (1, None), (None, 7), (None, 9_000), (0, 10_000), (2, 3)])]
    got = {r.tie: r.inter_arrival for r in reuse.inter_arrival(spark.createDataFrame(rows, COLS), ORDER).collect()}
    assert got == {0: 0, 1: 5, 2: 9_995, 8: 0, 4: 0, 5: 0, 3: 0, 6: 0, 7: 8_993, 9: 0}


@pytest.mark.parametrize("keys", [(), ("device_id",)])
def test_ranges_of_unique_distance_are_cut_by_accesses(spark, monkeypatch, keys):
    """Few requests of many blocks: a worker must not take them all at once."""
    from iolens.operators import unique_distance as U
    monkeypatch.setattr(U, "RANGE_ROWS", 100, raising=False)
    cuts, number = [], U.number_in_cells
    monkeypatch.setattr(U, "number_in_cells", lambda *a, **k: cuts.append(number(*a, **k)) or cuts[-1])
    rows = [(i % 2, "RW"[i % 3 == 0], (i * 7 % 30) * B, 12 * B, i, i) for i in range(120)]  # 1,440 accesses
    got = sorted(tuple(r[c] for c in ("opcode", "device_id", "block", "seq", "distance"))
                 for r in U.unique_reuse_distance(spark.createDataFrame(rows, COLS), ORDER, keys=keys).collect())
    assert cuts[0].nb >= 10
    parts = [[r for r in rows if r[0] == d] for d in (0, 1)] if keys else [rows]
    assert got == sorted(x for part in parts for x in unique_loop(part))


@pytest.mark.parametrize("name", ["unique_reuse_distance_bucketed", "unique_reuse_distance_per_device"])
def test_a_burst_of_long_requests_is_cut_by_accesses(spark, monkeypatch, tmp_path, name):
    """40 of 300 requests have 80 blocks and the others one: ranges of the mean number of requests would hold 1,300 accesses."""
    import datetime
    from iolens.operators import unique_distance as U
    from iolens.plans.order import BKT
    from iolens.queries import queries
    from iolens.sources import views as V
    monkeypatch.setattr(U, "RANGE_ROWS", 200)
    seen, carry = [], U._carry
    monkeypatch.setattr(U, "_carry", lambda ex, by: seen.append(ex) or carry(ex, by))
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(seconds=i), i % 2, "click" if i % 3 else "signup", 639.0 if 200 <= i < 240 else 1.0, f'{{"k": {i * 7 % 50}}}')
            for i in range(300)]
    cols = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, cols).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(tuple(r[c] for c in ("opcode", "device_id", "block", "seq", "distance")) for r in queries()[name](spark, str(tmp_path)).collect())
    assert max(r["count"] for r in seen[0].groupBy(BKT).count().collect()) < 2 * 200 + 81
    trace = [tuple(r) for r in V.trace(spark, str(tmp_path)).collect()]
    parts = [[r for r in trace if r[0] == d] for d in (0, 1)] if "device" in name else [trace]
    assert got == sorted(x for part in parts for x in unique_loop(part))


@pytest.mark.parametrize("keys", [(), ("device_id",)])
def test_requests_that_agree_in_the_whole_order_key_are_cut_by_accesses(spark, monkeypatch, keys):
    """No range of the order can part them, so the ordering gives them as one range."""
    from iolens.operators import unique_distance as U
    from iolens.plans.order import BKT
    monkeypatch.setattr(U, "RANGE_ROWS", 100)
    seen, run = [], U.explode_blocks
    monkeypatch.setattr(U, "explode_blocks", lambda *a, **k: seen.append(run(*a, **k)) or seen[-1])
    df = spark.createDataFrame([(0, "R", 0, 3 * B, None, None)] * 300, COLS)  # 900 accesses
    got = sorted((r.block, r.seq, r.distance) for r in U.unique_reuse_distance(df, ORDER, keys=keys).collect())
    assert max(r["count"] for r in seen[0].groupBy(BKT).count().collect()) < 2 * 100 + 4
    assert got == [(b, s, 0) for b in range(3) for s in range(1, 300)]
