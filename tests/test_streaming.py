"""Streaming forms agree with the batch operator."""

from iolens.operators import rates
from iolens.session import scratch_path
from iolens.sources import views as V
from iolens.streaming import rates as S

SF = "/root/testdata/sf0.001"


def test_incremental_counts_equal_batch_and_replay_is_idempotent(spark):
    t = V.trace_dense(spark, SF)
    src = scratch_path(spark, "t-src")
    t.repartition(4).write.csv(src)
    out, ck = scratch_path(spark, "t-out"), scratch_path(spark, "t-ck")
    S.count_incremental(spark, src, out, ck, files_per_trigger=1)
    S.count_incremental(spark, src, out, ck, files_per_trigger=1)  # nothing new: no change
    got = {r.bin_start: r.kreq for r in S.read_counts(spark, out).collect()}
    want = {r.bin_start: r.kreq for r in rates.requests_per_unit(t).collect()}
    assert got == want
    assert spark.read.parquet(out).select("batch_id").distinct().count() == 4


def test_windowed_counts_with_watermark(spark):
    t = V.trace_dense(spark, SF)
    src = scratch_path(spark, "w-src")
    t.repartition(3).write.csv(src)
    q = (S.windowed_counts(S.trace_stream(spark, src, 1), "minute", "0 seconds")
         .writeStream.outputMode("complete").format("memory").queryName("wc_test").start())
    q.processAllAvailable()
    q.stop()
    got = {r.bin_start: r.n for r in spark.table("wc_test").collect()}
    want = {r.bin_start: int(round(r.kreq * 1000)) for r in rates.requests_per_unit(t, "minute").collect()}
    assert got == want
