"""Loaders on hand-written text: malformed lines, comments, no final newline."""

import os

from iolens.session import scratch_path
from iolens.sources import readers as R


def _write(spark, name, text):
    p = scratch_path(spark, name).removeprefix("file:")
    os.makedirs(p, exist_ok=True)
    with open(os.path.join(p, "part-0.csv"), "w") as f:
        f.write(text)
    return p


def test_tolerant_loader_keeps_last_line_and_skips_bad(spark):
    text = ("1,R,4096,512,100\n"
            "1,R,4096,512\n"             # 4 fields
            "1,W,0,512,101,9\n"          # 6 fields
            "1,W,x,512,102\n"            # offset not a number
            " 2,W,8192,1024,103 \n"      # surrounding blanks are fine
            "\n"
            "3,R,0,512,104")             # no final newline
    df = R.load_trace_tolerant(spark, _write(spark, "tol", text))
    got = sorted(tuple(r) for r in df.collect())
    assert got == [(1, "R", 4096, 512, 100), (2, "W", 8192, 1024, 103), (3, "R", 0, 512, 104)]


def test_tolerant_loader_time_window_is_inclusive(spark):
    t0 = R.to_micros("2020-01-01 00:00:00")
    h = 3_600_000_000
    text = "\n".join(f"1,R,0,512,{t}" for t in (t0 - 1, t0, t0 + h, t0 + h + 1))
    df = R.load_trace_tolerant(spark, _write(spark, "tolw", text), start="2020-01-01 00:00:00", nhours=1)
    assert sorted(r.timestamp for r in df.collect()) == [t0, t0 + h]


def test_start_with_or_without_fraction():
    assert R.to_micros("2020-01-01 00:00:00") == R.to_micros("2020-01-01 00:00:00.000000") == 1577836800000000


def test_object_loader_comments_and_blanks(spark):
    text = ("# header comment\n"
            "310 262144 4325376 1572074461.57806 1 ns1 u1 3 5 h1\n"
            "   # indented comment\n"
            "311\t0  4096 1572074462.5 4 ns2 u2 0 1 h2\n"
            "short line 1 2\n"
            "312 0 8192 1572074463.0 100 ns3 u3 1 1 h3")
    df = R.load_object_trace(spark, _write(spark, "obj", text), bad_lines="skip")
    rows = sorted(df.collect(), key=lambda r: r.block_id)
    assert [r.block_id for r in rows] == [310, 311, 312]
    assert rows[0].time == 1572074461.57806 and rows[1].op_name == 4 and rows[2].host_name == "h3"


def test_stride_keeps_every_kth_line(spark):
    text = "\n".join(f"0,R,0,512,{1000 + i}" for i in range(25))
    df = R.load_trace_stride(spark, _write(spark, "stride", text), k=10)
    assert sorted(r.timestamp for r in df.collect()) == [1000, 1010, 1020]


def test_sector_loader_normalizes_units(spark):
    text = "1577836800,8,16,0,5\n1577836801,0,1,1,5\n"
    df = R.load_sector_trace(spark, _write(spark, "sector", text))
    got = sorted(tuple(r) for r in df.collect())
    assert got == [(5, "R", 4096, 8192, 1577836800000000), (5, "W", 0, 512, 1577836801000000)]


LINES = ["0,R,0,512,10", "1,W,8,512,20", "1,W,8", "2,R,x,512,30", "3,R,16,512,40,9", "4,W,24,512,50"]


def test_bad_lines_do_not_depend_on_the_columns_read(spark):
    p = _write(spark, "bad", "\n".join(LINES) + "\n")
    df = R.load_trace_range(spark, p)
    assert len(df.collect()) == df.count() == df.select("device_id").count() == 3
    assert R.load_trace_tolerant(spark, p, nrows=2).select("device_id").count() == 2
    s = R.load_sector_trace(spark, _write(spark, "bads", "1,2,3,0,5\n1,x,3,0,5\n1,2,3,0\n"), normalize=False)
    assert [tuple(r) for r in s.collect()] == [(1, 2, 3, 0, 5)] and s.select("Size").count() == 1


def test_stride_counts_lines_of_the_file(spark):
    lines = [f"{i},R,0,512,{i * 10}" for i in range(10)]
    lines[3] = "broken"
    lines[4] = "4,R,0,512,"
    got = R.load_trace_stride(spark, _write(spark, "stride", "\n".join(lines) + "\n"), k=4)
    assert sorted(r.device_id for r in got.collect()) == [0, 8]
    got = R.load_trace_stride(spark, _write(spark, "stride", "\n".join(lines) + "\n"), k=4, nrows=2)
    assert sorted(r.device_id for r in got.collect()) == [0]


def test_object_lines_with_eight_or_ten_fields_and_comments(spark):
    import pytest

    text = "# head\n310 262144 4325376 1572074461.57806 1 24 3 5\n\t7 1 2 3.5 2 a b 4 9 host # note\n  \n"
    rows = sorted(R.load_object_trace(spark, _write(spark, "obj", text)).collect(), key=lambda r: r.block_id)
    assert [(r.block_id, r.rs_shard_id, r.op_count, r.host_name) for r in rows] == [(7, 4, 9, "host"), (310, 5, None, None)]
    with pytest.raises(Exception, match="eight or ten"):
        R.load_object_trace(spark, _write(spark, "obj", "1 2 3\n")).count()


def test_object_lines_with_bad_numbers_are_errors_or_left_out(spark):
    import pytest

    good = "310 262144 4325376 1572074461.5 1 ns1 u1 3 5 h1"
    for bad in ("310 262144 x 1572074461.5 1 ns1 u1 3 5 h1", "310 262144 1.5 1572074461.5 1 ns1 u1 3 5 h1", "310 1 2 when 1 ns1 u1 3 5 h1",
                "310 1 2 3.5 99999999999 ns1 u1 3 5 h1"):
        p = _write(spark, "objbad", f"{good}\n{bad}\n")
        with pytest.raises(Exception, match="bad number"):
            R.load_object_trace(spark, p).count()
        assert [r.io_size for r in R.load_object_trace(spark, p, bad_lines="skip").collect()] == [4325376]


def test_quotes_and_signs_are_plain_text(spark):
    p = _write(spark, "quote", '1,"R,4096,512,100\n1,"R",4096,512,101\n+1,W,-8,512,102\n1,W,8.0,512,103\n1,#,8,512,104\n99999999999,R,0,1,5\n')
    got = sorted((r.timestamp, r.device_id, r.opcode, r.offset) for r in R.load_trace_range(spark, p).collect())
    assert got == [(100, 1, '"R', 4096), (101, 1, '"R"', 4096), (102, 1, "W", -8), (104, 1, "#", 8)]
    lines = spark.read.text(p)
    assert sorted(r.timestamp for r in R._parsed(lines, R.CANONICAL).collect()) == [100, 101, 102, 104]


def test_sample_is_spread_and_depends_on_the_seed(spark):
    from iolens.sources import writers as W
    n = 20_000
    df = spark.range(n).selectExpr("cast(id % 5 as int) device_id", "'R' opcode", "id * 8 as offset", "512 as length", "id as timestamp")
    a = {r.timestamp for r in W.sample_n_rows(df, rate=0.1, seed=1).collect()}
    b = {r.timestamp for r in W.sample_n_rows(df, rate=0.1, seed=2).collect()}
    assert len(a) == len(b) == n // 10 and len(a & b) < n // 50
    for k in range(10):
        assert 140 <= sum(k * n // 10 <= t < (k + 1) * n // 10 for t in a) <= 260


def test_ranges_of_an_annotated_trace_follow_the_tables_it_reads(spark, tmp_path, monkeypatch):
    """Spark takes a join's size for the product of both sides; the sink's ranges must not."""
    import re

    from iolens.operators import reuse
    from iolens.sources import writers as W
    p = str(tmp_path / "trace")
    cols = "device_id int, opcode string, offset long, length int, timestamp long"
    rows = [(k % 3, "RW"[k % 2], (k % 40) * 4096, 8192, k) for k in range(3000)]
    spark.createDataFrame(rows, cols).write.parquet(p)
    a = reuse.annotate_first_reuse(spark.read.parquet(p), ["timestamp", "device_id", "offset"])
    monkeypatch.setattr(W, "TASK_BYTES", 4096)
    plan = W._layout(a, None)._jdf.queryExecution().optimizedPlan().toString()
    ranges = int(re.search(r"RepartitionByExpression \[.*?\], (\d+)", plan).group(1))
    assert ranges <= 100
    out = spark.read.parquet(W.write_annotated_trace(a, str(tmp_path / "out")))
    assert sorted(map(tuple, out.select(*a.columns).collect())) == sorted(map(tuple, a.collect()))
