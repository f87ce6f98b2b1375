"""Aggregation queries (A*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from iolens.operators import summary
from iolens.queries import register
from iolens.sources import views as V
from iolens.sources.views import with_views

_TIME_TXT = "strftime(make_timestamp({c}), '%Y-%m-%d %H:%M:%S.%f')"


@register("trace_summary", with_views(f"""
SELECT count(*) FILTER (WHERE opcode = 'R') AS reads,
       count(*) FILTER (WHERE opcode = 'W') AS writes,
       CASE WHEN count(*) > 0 THEN (count(*) FILTER (WHERE opcode = 'R')) / count(*) ELSE 0.0 END AS read_ratio,
       CASE WHEN count(*) > 0 THEN (count(*) FILTER (WHERE opcode = 'W')) / count(*) ELSE 0.0 END AS write_ratio,
       min("length") / 1024.0 AS length_min_kb, max("length") / 1024.0 AS length_max_kb,
       min("offset") / 1048576.0 AS offset_min_mb, max("offset") / 1048576.0 AS offset_max_mb,
       {_TIME_TXT.format(c='min("timestamp")')} AS time_min,
       {_TIME_TXT.format(c='max("timestamp")')} AS time_max
FROM trace""", "trace"))
def q_trace_summary(spark, sf):
    return summary.trace_summary(V.trace(spark, sf))


@register("sector_trace_summary", with_views("""
SELECT count(*) FILTER (WHERE "IOType" = 0) AS reads,
       count(*) FILTER (WHERE "IOType" = 1) AS writes,
       CASE WHEN count(*) > 0 THEN (count(*) FILTER (WHERE "IOType" = 0)) / count(*) ELSE 0.0 END AS read_ratio,
       CASE WHEN count(*) > 0 THEN (count(*) FILTER (WHERE "IOType" = 1)) / count(*) ELSE 0.0 END AS write_ratio,
       min("Size") AS size_min, max("Size") AS size_max,
       min("Offset") AS offset_min, max("Offset") AS offset_max,
       min("Timestamp") AS time_min, max("Timestamp") AS time_max
FROM sector_trace""", "sector_trace"))
def q_sector_trace_summary(spark, sf):
    return summary.sector_trace_summary(V.sector_trace(spark, sf))


# ------------------------------------------------------------------ rates (V2)
from iolens.operators import rates, sizes  # noqa: E402

D = "CAST({} AS DOUBLE)"


@register("requests_per_unit", with_views("""
SELECT "timestamp" - "timestamp" % 1000000 AS bin_start, count(*) / CAST(1000 AS DOUBLE) AS kreq
FROM trace_dense GROUP BY 1""", "trace_dense"))
def q_requests_per_unit(spark, sf):
    return rates.requests_per_unit(V.trace_dense(spark, sf), "second")


@register("mean_rate_resampled", with_views("""
, a3 AS (SELECT "timestamp" - "timestamp" % 1000000 AS bin_start, count(*) / CAST(1000 AS DOUBLE) AS kreq
         FROM trace_dense GROUP BY 1),
  b AS (SELECT min(bin_start) AS lo, max(bin_start) AS hi FROM a3),
  g AS (SELECT unnest(generate_series(lo, hi, 1000000)) AS bin_start FROM b)
SELECT g.bin_start, a3.kreq AS mean_kreq FROM g LEFT JOIN a3 USING (bin_start)""", "trace_dense"))
def q_mean_rate_resampled(spark, sf):
    return rates.mean_rate_resampled(V.trace_dense(spark, sf), "second")


@register("iops_mean_peak", with_views("""
, s AS (SELECT "timestamp" - "timestamp" % 1000000 AS sec, count(*) AS n FROM trace_dense GROUP BY 1),
  a AS (SELECT min(sec) AS f, max(sec) AS l, min(sec) - min(sec) % 86400000000 AS d0 FROM s),
  agg AS (SELECT s.sec - (s.sec - a.d0) % 10000000 AS bin_start, sum(n) / count(*) AS mean_iops,
                 max(n) AS peak_iops FROM s, a GROUP BY 1),
  g AS (SELECT unnest(generate_series(f - (f - d0) % 10000000, l - (l - d0) % 10000000, 10000000)) AS bin_start FROM a)
SELECT g.bin_start, agg.mean_iops, agg.peak_iops FROM g LEFT JOIN agg USING (bin_start)""", "trace_dense"))
def q_iops_mean_peak(spark, sf):
    return rates.iops_mean_peak(V.trace_dense(spark, sf), 10)


@register("interval_count_avg_peak", with_views("""
, c AS (SELECT "timestamp" - "timestamp" % 60000000 AS bin_start, count(*) AS requests FROM trace_dense GROUP BY 1)
SELECT bin_start, requests, (sum(requests) OVER ()) / (count(*) OVER ()) AS avg_requests,
       max(requests) OVER () AS peak_requests FROM c""", "trace_dense"))
def q_interval_count_avg_peak(spark, sf):
    return rates.interval_count_avg_peak(V.trace_dense(spark, sf), 60)


@register("device_totals", with_views("""
SELECT device_id, count(*) AS requests FROM trace_dense GROUP BY 1""", "trace_dense"))
def q_device_totals(spark, sf):
    return rates.device_totals(V.trace_dense(spark, sf))


@register("busiest_device_rate", with_views("""
, t AS (SELECT device_id, count(*) AS n FROM trace_dense GROUP BY 1 ORDER BY n DESC, device_id LIMIT 1)
SELECT device_id, "timestamp" - "timestamp" % 1000000 AS bin_start, count(*) / CAST(1000 AS DOUBLE) AS kreq
FROM trace_dense WHERE device_id IN (SELECT device_id FROM t) GROUP BY 1, 2""", "trace_dense"))
def q_busiest_device_rate(spark, sf):
    return rates.busiest_device_rate(V.trace_dense(spark, sf), "second")


@register("hourly_mean_size", with_views("""
SELECT device_id, "timestamp" - "timestamp" % 3600000000 AS hour, sum("length") / count(*) AS mean_size
FROM trace GROUP BY 1, 2""", "trace"))
def q_hourly_mean_size(spark, sf):
    return rates.hourly_mean_size(V.trace(spark, sf), keys=["device_id"])


# ------------------------------------------------------------------ sizes (V2)
@register("small_request_share", with_views("""
SELECT opcode, count(*) FILTER (WHERE "length" <= 4096) / count(*) * CAST(100 AS DOUBLE) AS small_pct
FROM trace_dense GROUP BY 1""", "trace_dense"))
def q_small_request_share(spark, sf):
    return sizes.small_request_share(V.trace_dense(spark, sf))


@register("size_p99", with_views("""
SELECT opcode, quantile_cont("length" / CAST(1024 AS DOUBLE), 0.99) AS p99_kb
FROM trace_dense GROUP BY 1""", "trace_dense"))
def q_size_p99(spark, sf):
    return sizes.size_p99(V.trace_dense(spark, sf))


@register("size_cdf_sampled", with_views("""
, s AS (SELECT opcode, "length", row_number() OVER (PARTITION BY opcode ORDER BY "length") - 1 AS i,
               count(*) OVER (PARTITION BY opcode) AS n FROM trace_dense),
  t AS (SELECT opcode, n, unnest(generate_series(0, 999)) AS point
        FROM (SELECT DISTINCT opcode, n FROM s) WHERE n > 1000),
  tb AS (SELECT opcode, CAST(point AS INTEGER) AS point,
                CASE WHEN point = 999 THEN n - 1 ELSE CAST(trunc(point * ((n - 1) / CAST(999 AS DOUBLE))) AS BIGINT) END AS rnk,
                CASE WHEN point = 999 THEN CAST(1 AS DOUBLE) ELSE point * (CAST(1 AS DOUBLE) / 999) END AS cdf FROM t),
  tsm AS (SELECT opcode, CAST(i AS INTEGER) AS point, i AS rnk, (i + 1) / n AS cdf FROM s WHERE n <= 1000)
SELECT s.opcode, tb.point, s."length", tb.cdf FROM tb JOIN s ON s.opcode = tb.opcode AND s.i = tb.rnk
UNION ALL
SELECT s.opcode, tsm.point, s."length", tsm.cdf FROM tsm JOIN s ON s.opcode = tsm.opcode AND s.i = tsm.rnk""",
    "trace_dense"))
def q_size_cdf_sampled(spark, sf):
    return sizes.size_cdf_sampled(V.trace_dense(spark, sf))


def _pct_sql(src: str, keys: str, x: str, order: str, stop: str, xname: str) -> str:
    """DuckDB brute force for the linspace CDF, grouped to the histogram form."""
    return f"""
, s AS (SELECT {keys}, {x} AS {xname}, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) - 1 AS i,
               count(*) OVER (PARTITION BY {keys}) AS n FROM {src}),
  g AS (SELECT {keys}, {xname}, count(*) AS cnt, min(i) AS fi, max(i) AS li, any_value(n) AS n FROM s GROUP BY ALL)
SELECT {keys}, {xname}, cnt,
  CASE WHEN n = 1 THEN CAST(0 AS DOUBLE) WHEN fi = n - 1 THEN CAST({stop} AS DOUBLE)
       ELSE fi * (CAST({stop} AS DOUBLE) / (n - 1)) END AS pct_first,
  CASE WHEN n = 1 THEN CAST(0 AS DOUBLE) WHEN li = n - 1 THEN CAST({stop} AS DOUBLE)
       ELSE li * (CAST({stop} AS DOUBLE) / (n - 1)) END AS pct_last
FROM g"""


@register("size_cdf_percent", with_views(
    _pct_sql("trace_dense", "opcode", '"length" / CAST(1024 AS DOUBLE)', '"length"', "100", "size_kb"),
    "trace_dense"))
def q_size_cdf_percent(spark, sf):
    return sizes.size_cdf_percent(V.trace_dense(spark, sf))


# ------------------------------------------------------------- features (V1)
from iolens.operators import features  # noqa: E402
from iolens.queries.sqlparts import SEQ_TRACE  # noqa: E402

IA_SQL = SEQ_TRACE + """
, ia AS (SELECT *, coalesce("timestamp" - lag("timestamp") OVER (PARTITION BY device_id ORDER BY seq), 0) AS ia,
                CASE opcode WHEN 'R' THEN 1 WHEN 'W' THEN 0 END AS opi FROM r)"""
A15_SQL = IA_SQL + """
, a15 AS (SELECT device_id, count(*) AS io_count, sum("length") / count(*) AS io_size_avg,
                 coalesce(stddev_samp("length"), 0) AS io_size_std, sum(opi) / count(opi) AS read_write_ratio,
                 sum(ia) / count(ia) AS response_time_avg, coalesce(stddev_samp(ia), 0) AS response_time_std
          FROM ia GROUP BY 1)"""

# Standard deviations differ between engines in the last bits (summation
# order); the registered queries round them on both sides.
STD_DIGITS = {"io_size_std": 6, "response_time_std": 3, "interval_std": 3}


def _round_std(df):
    return df.select(*[F.round(c, STD_DIGITS[c]).alias(c) if c in STD_DIGITS else F.col(c) for c in df.columns])


@register("device_features", with_views(A15_SQL + """
SELECT * REPLACE (round(io_size_std, 6) AS io_size_std, round(response_time_std, 3) AS response_time_std)
FROM a15""", "trace"))
def q_device_features(spark, sf):
    return _round_std(features.device_features(V.trace(spark, sf), V.TRACE_ORDER))


@register("window_features", with_views(IA_SQL + """
SELECT device_id, "timestamp" // 3600000000 AS time_window, count(*) AS avg_io_count,
       sum("length") / count(*) AS avg_io_size, round(coalesce(stddev_samp("length"), 0), 6) AS io_size_std,
       sum(opi) / count(opi) AS read_write_ratio, sum(ia) / count(ia) AS avg_response_time,
       sum(ia) / count(ia) AS interval_mean, round(coalesce(stddev_samp(ia), 0), 3) AS interval_std
FROM ia GROUP BY 1, 2""", "trace"))
def q_window_features(spark, sf):
    return _round_std(features.window_features(V.trace(spark, sf), V.TRACE_ORDER))


def _z_sql(cols):
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in cols)
    zs = ",\n       ".join(
        f"round(CASE WHEN s_{c} IS NULL OR s_{c} = 0 THEN CAST(0 AS DOUBLE) ELSE ({c} - m_{c}) / s_{c} END, 6) AS z_{c}"
        for c in cols)
    return A15_SQL + f"""
, st AS (SELECT {stats} FROM a15)
SELECT device_id, {zs}
FROM a15 CROSS JOIN st"""


@register("standardize", with_views(_z_sql(features.DEVICE_FEATURES), "trace"))
def q_standardize(spark, sf):
    f = features.device_features(V.trace(spark, sf), V.TRACE_ORDER)
    z = features.standardize(f, features.DEVICE_FEATURES)
    return z.select("device_id", *[F.round("z_" + c, 6).alias("z_" + c) for c in features.DEVICE_FEATURES])


# ------------------------------------------------------- incremental A3 (V2)
from iolens.session import scratch_path  # noqa: E402
from iolens.streaming import rates as stream_rates  # noqa: E402


@register("requests_per_unit_incremental", with_views("""
SELECT "timestamp" - "timestamp" % 1000000 AS bin_start, count(*) / CAST(1000 AS DOUBLE) AS kreq
FROM trace_dense GROUP BY 1""", "trace_dense"))
def q_requests_per_unit_incremental(spark, sf):
    src = scratch_path(spark, "stream-src")
    V.trace_dense(spark, sf).repartition(6).write.csv(src)
    out = scratch_path(spark, "stream-out")
    stream_rates.count_incremental(spark, src, out, scratch_path(spark, "stream-ckpt"), "second",
                                   files_per_trigger=2)
    return stream_rates.read_counts(spark, out)


# --------------------------------------------- keyed by device (per-device runs)
@register("iops_mean_peak_per_device", with_views("""
, s AS (SELECT device_id, "timestamp" - "timestamp" % 1000000 AS sec, count(*) AS n FROM trace_dense GROUP BY 1, 2),
  a AS (SELECT device_id, min(sec) AS f, max(sec) AS l, min(sec) - min(sec) % 86400000000 AS d0 FROM s GROUP BY 1),
  agg AS (SELECT s.device_id, s.sec - (s.sec - a.d0) % 10000000 AS bin_start, sum(n) / count(*) AS mean_iops,
                 max(n) AS peak_iops FROM s JOIN a USING (device_id) GROUP BY 1, 2),
  g AS (SELECT device_id, unnest(generate_series(f - (f - d0) % 10000000, l - (l - d0) % 10000000, 10000000))
               AS bin_start FROM a)
SELECT g.device_id, g.bin_start, agg.mean_iops, agg.peak_iops FROM g LEFT JOIN agg USING (device_id, bin_start)""",
    "trace_dense"))
def q_iops_mean_peak_per_device(spark, sf):
    return rates.iops_mean_peak(V.trace_dense(spark, sf), 10, keys=["device_id"])


@register("size_cdf_sampled_per_device", with_views("""
, s AS (SELECT device_id, opcode, "length",
               row_number() OVER (PARTITION BY device_id, opcode ORDER BY "length") - 1 AS i,
               count(*) OVER (PARTITION BY device_id, opcode) AS n FROM trace_dense),
  t AS (SELECT device_id, opcode, n, unnest(generate_series(0, 999)) AS point
        FROM (SELECT DISTINCT device_id, opcode, n FROM s) WHERE n > 1000),
  tb AS (SELECT device_id, opcode, CAST(point AS INTEGER) AS point,
                CASE WHEN point = 999 THEN n - 1 ELSE CAST(trunc(point * ((n - 1) / CAST(999 AS DOUBLE))) AS BIGINT) END AS rnk,
                CASE WHEN point = 999 THEN CAST(1 AS DOUBLE) ELSE point * (CAST(1 AS DOUBLE) / 999) END AS cdf FROM t),
  tsm AS (SELECT device_id, opcode, CAST(i AS INTEGER) AS point, i AS rnk, (i + 1) / n AS cdf FROM s WHERE n <= 1000)
SELECT s.device_id, s.opcode, tb.point, s."length", tb.cdf FROM tb
  JOIN s ON s.device_id = tb.device_id AND s.opcode = tb.opcode AND s.i = tb.rnk
UNION ALL
SELECT s.device_id, s.opcode, tsm.point, s."length", tsm.cdf FROM tsm
  JOIN s ON s.device_id = tsm.device_id AND s.opcode = tsm.opcode AND s.i = tsm.rnk""", "trace_dense"))
def q_size_cdf_sampled_per_device(spark, sf):
    return sizes.size_cdf_sampled(V.trace_dense(spark, sf), keys=["device_id"])
