"""Access-count and access-pattern queries."""

from __future__ import annotations

from iolens.operators import access, reuse
from iolens.queries import register
from iolens.queries.sqlparts import SEQ_TRACE, exploded
from iolens.sources import views as V
from iolens.sources.views import with_views

A11_SQL = f"""
, e AS ({exploded('trace', 'cover', 'device_id')}),
  a11 AS (SELECT device_id, block, count(*) AS accesses FROM e GROUP BY 1, 2)"""


def _counts(spark, sf):
    return access.block_access_counts(V.trace(spark, sf), "cover")


@register("block_access_counts", with_views(A11_SQL + "\nSELECT * FROM a11", "trace"))
def q_block_access_counts(spark, sf):
    return _counts(spark, sf)


@register("access_summary", with_views(A11_SQL + """
SELECT count(*) AS unique_blocks, min(accesses) AS min_accesses, max(accesses) AS max_accesses,
       sum(accesses) / count(*) AS mean_accesses FROM a11""", "trace"))
def q_access_summary(spark, sf):
    return access.access_summary(_counts(spark, sf))


@register("access_count_distribution", with_views(A11_SQL + """
SELECT accesses, count(*) AS blocks FROM a11 GROUP BY 1""", "trace"))
def q_access_count_distribution(spark, sf):
    return access.access_count_distribution(_counts(spark, sf))


@register("access_histogram_log", with_views(A11_SQL + """
, mm AS (SELECT min(accesses) AS mn, max(accesses) AS mx FROM a11),
  ed AS (SELECT t.i AS i,
                CASE WHEN t.i = 0 THEN CAST(mn AS DOUBLE) WHEN t.i = 16 THEN CAST(mx AS DOUBLE)
                     ELSE pow(10, t.i * ((log10(mx) - log10(mn)) / CAST(16 AS DOUBLE)) + log10(mn)) END AS e
         FROM mm CROSS JOIN generate_series(0, 16) t(i)),
  b AS (SELECT a.i AS bin, a.e AS lo, b.e AS hi FROM ed a JOIN ed b ON b.i = a.i + 1),
  c AS (SELECT b.bin, count(*) AS n FROM a11 JOIN b ON a11.accesses >= b.lo
          AND (a11.accesses < b.hi OR (b.bin = 15 AND a11.accesses <= b.hi)) GROUP BY 1)
SELECT b.bin, round(lo, 6) AS lo, round(hi, 6) AS hi, coalesce(c.n, 0) AS blocks
FROM b LEFT JOIN c USING (bin)""", "trace"))
def q_access_histogram_log(spark, sf):
    return access.access_histogram_log(_counts(spark, sf))


@register("access_nearest_rank", with_views(A11_SQL + """
, s AS (SELECT accesses, row_number() OVER (ORDER BY accesses) - 1 AS i, count(*) OVER () AS n FROM a11)
SELECT max(accesses) FILTER (WHERE i = CAST(trunc(n * CAST(0.9 AS DOUBLE)) AS BIGINT)) AS p90,
       max(accesses) FILTER (WHERE i = CAST(trunc(n * CAST(0.99 AS DOUBLE)) AS BIGINT)) AS p99
FROM s""", "trace"))
def q_access_nearest_rank(spark, sf):
    return access.access_nearest_rank(_counts(spark, sf))


@register("access_count_cdf", with_views(A11_SQL + """
, s AS (SELECT accesses, row_number() OVER (ORDER BY accesses) - 1 AS i, count(*) OVER () AS n FROM a11)
SELECT accesses, count(*) AS cnt, (min(i) + 1) / any_value(n) AS cdf_first, (max(i) + 1) / any_value(n) AS cdf_last
FROM s GROUP BY 1""", "trace"))
def q_access_count_cdf(spark, sf):
    return access.access_count_cdf(_counts(spark, sf))


@register("access_space", with_views(f"""
SELECT "timestamp", device_id, block FROM ({exploded('trace', 'cover', 'device_id, "timestamp"')})""",
    "trace"))
def q_access_space(spark, sf):
    return access.access_space(V.trace(spark, sf))


@register("access_arrival", with_views(SEQ_TRACE + f"""
, e AS ({exploded('r', 'cover', 'device_id, seq, "timestamp"')}),
  f AS (SELECT device_id, block, min(seq) AS first_seq FROM e GROUP BY 1, 2),
  w11 AS (SELECT device_id, block, row_number() OVER (ORDER BY first_seq, block) - 1 AS rank FROM f)
SELECT e."timestamp", e.device_id, e.block, w11.rank FROM e JOIN w11 USING (device_id, block)""", "trace"))
def q_access_arrival(spark, sf):
    t = V.trace(spark, sf)
    return access.access_arrival(t, reuse.first_arrival_rank(t, V.TRACE_ORDER))


_NORM = """, nt AS (SELECT "VolumeID" AS device_id, "Offset" * 512 AS "offset", "Size" * 512 AS "length",
                  "Timestamp" * 1000000 AS "timestamp" FROM sector_trace)"""


@register("access_pattern_sector", with_views(_NORM + f"""
SELECT "timestamp", device_id, block FROM ({exploded('nt', 'cover', 'device_id, "timestamp"')})""",
    "sector_trace"))
def q_access_pattern_sector(spark, sf):
    return access.access_pattern_sector(V.sector_trace(spark, sf))


@register("access_raw_offset", with_views("""
SELECT "Timestamp" AS time_s, "Offset" AS "offset" FROM sector_trace""", "sector_trace"))
def q_access_raw_offset(spark, sf):
    return access.access_raw_offset(V.sector_trace(spark, sf))


@register("access_raw_offset_summary", with_views("""
, per AS (SELECT "Offset", count(*) AS accesses FROM sector_trace GROUP BY 1)
SELECT count(*) AS unique_offsets, min(accesses) AS min_accesses, max(accesses) AS max_accesses,
       sum(accesses) / count(*) AS mean_accesses FROM per""", "sector_trace"))
def q_access_raw_offset_summary(spark, sf):
    return access.access_raw_offset_summary(V.sector_trace(spark, sf))


@register("access_heatgrid", with_views(f"""
, e AS ({exploded('trace', 'cover', 'device_id, "timestamp"')})
SELECT device_id, "timestamp" - "timestamp" % 3600000000 AS time_bin, block // 1024 AS block_bin,
       count(*) AS accesses FROM e GROUP BY 1, 2, 3""", "trace"))
def q_access_heatgrid(spark, sf):
    return access.access_heatgrid(V.trace(spark, sf), 3600, 1024)
