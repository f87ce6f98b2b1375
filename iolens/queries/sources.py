"""Source / sink queries.

Each writes text or Parquet derived from the driver's tables into a fresh
folder under the shared checkpoint location, reads it back with the loader
under test, and returns the loaded rows. The oracle is the view itself with
the same restrictions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from iolens.operators import features, reuse, summary
from iolens.queries import register
from iolens.queries.aggregates import A15_SQL, _round_std
from iolens.queries.sqlparts import volume
from iolens.session import scratch_path
from iolens.sources import readers as R
from iolens.sources import views as V
from iolens.sources import writers as W
from iolens.sources.views import with_views

CANON = ["device_id", "opcode", "offset", "length", "timestamp"]
CANON_SQL = 'device_id, opcode, "offset", "length", "timestamp"'
T0_TXT = "2024-01-05 00:00:00"
T0 = R.to_micros(T0_TXT)


def _corrupt_csv(spark, sf):
    """Lines in trace order, some broken (see ``_corrupt_lines``)."""
    p = scratch_path(spark, "trace-csv")
    t = V.trace(spark, sf).orderBy("timestamp", "tie")
    _corrupt_lines(t).write.text(p)
    return p


@register("load_trace_range", with_views(f"""
SELECT {CANON_SQL} FROM trace WHERE tie % 97 > 2 AND "timestamp" BETWEEN {T0} AND {T0 + 240 * R.HOUR_US}""", "trace"))
def q_load_trace_range(spark, sf):
    return R.load_trace_range(spark, _corrupt_csv(spark, sf), start=T0_TXT, nhours=240)


@register("load_trace_range_one_column", with_views("""
SELECT device_id, count(*) AS requests FROM trace WHERE tie % 97 > 2 GROUP BY 1""", "trace"))
def q_load_trace_range_one_column(spark, sf):
    """The rows are the same when one column is read."""
    return R.load_trace_range(spark, _corrupt_csv(spark, sf)).select("device_id").groupBy("device_id").agg(
        F.count(F.lit(1)).alias("requests"))


@register("load_trace_nrows", with_views(f"""
SELECT {CANON_SQL} FROM trace WHERE tie % 97 > 2
ORDER BY "timestamp", device_id, opcode, "offset", "length" LIMIT 250""", "trace"))
def q_load_trace_nrows(spark, sf):
    """S1/S2 with nrows: the first rows of the trace."""
    return R.load_trace_tolerant(spark, _corrupt_csv(spark, sf), nrows=250)


def _corrupt_lines(t):
    """Lines of the canonical CSV, broken by a rule the oracle can repeat."""
    line = F.concat_ws(",", *[F.col(c).cast("string") for c in CANON])
    r = F.col("tie") % 97
    no_last = F.concat_ws(",", *[F.col(c).cast("string") for c in CANON[:-1]])
    bad_offset = F.concat_ws(",", F.col("device_id").cast("string"), "opcode", F.lit("x"),
                             F.col("length").cast("string"), F.col("timestamp").cast("string"))
    return t.select(F.when(r == 0, no_last).when(r == 1, F.concat(line, F.lit(",7")))
                    .when(r == 2, bad_offset).otherwise(line).alias("value"))


@register("load_trace_tolerant", with_views(f"""
SELECT {CANON_SQL} FROM trace WHERE tie % 97 > 2
  AND "timestamp" BETWEEN {T0} AND {T0 + 480 * R.HOUR_US}""", "trace"))
def q_load_trace_tolerant(spark, sf):
    p = scratch_path(spark, "trace-text")
    _corrupt_lines(V.trace(spark, sf)).write.text(p)
    return R.load_trace_tolerant(spark, p, start=T0_TXT, nhours=480)


@register("load_trace_stride", with_views(f"""
, r AS (SELECT *, row_number() OVER (ORDER BY "timestamp", tie) - 1 AS line FROM trace),
  k AS (SELECT * FROM r WHERE line % 10 = 0 AND tie % 97 > 2),
  t AS (SELECT min("timestamp") AS t0 FROM k)
SELECT {CANON_SQL} FROM k CROSS JOIN t WHERE "timestamp" <= t0 + {240 * R.HOUR_US}""", "trace"))
def q_load_trace_stride(spark, sf):
    return R.load_trace_stride(spark, _corrupt_csv(spark, sf), k=10, nhours=240)


@register("load_sector_trace", with_views(f"""
SELECT "VolumeID" AS device_id, CASE WHEN "IOType" = 0 THEN 'R' ELSE 'W' END AS opcode,
       "Offset" * 512 AS "offset", CAST("Size" * 512 AS INTEGER) AS "length", "Timestamp" * 1000000 AS "timestamp"
FROM sector_trace WHERE tie % 89 > 1 AND "Timestamp" BETWEEN {T0 // 1000000} AND {T0 // 1000000 + 360 * 3600}""",
    "sector_trace"))
def q_load_sector_trace(spark, sf):
    p = scratch_path(spark, "sector-csv")
    cols = ["Timestamp", "Offset", "Size", "IOType", "VolumeID"]
    line, r = F.concat_ws(",", *[F.col(c).cast("string") for c in cols]), F.col("tie") % 89
    V.sector_trace(spark, sf).select(F.when(r == 0, F.concat(line, F.lit("x"))).when(r == 1, F.concat(line, F.lit(",1")))
                                     .otherwise(line).alias("value")).write.text(p)
    return R.load_sector_trace(spark, p, start=T0_TXT, nhours=360)


OBJ_SQL = ", ".join(f'"{n}"' for n, _ in R.OBJECT_FIELDS)


def _objects(spark, sf):
    p = scratch_path(spark, "object-text")
    W.object_text(V.object_trace(spark, sf)).write.text(p)
    return R.load_object_trace(spark, p)


@register("load_object_trace", with_views(f"SELECT {OBJ_SQL} FROM object_trace", "object_trace"))
def q_load_object_trace(spark, sf):
    return _objects(spark, sf)


@register("write_objects", with_views(f"SELECT {OBJ_SQL} FROM object_trace", "object_trace"))
def q_write_objects(spark, sf):
    p = W.write_objects(_objects(spark, sf), scratch_path(spark, "objects-parquet"))
    return spark.read.parquet(p)


def _split(spark, sf):
    return W.split_by_device(V.trace(spark, sf), scratch_path(spark, "by-device"))


S6_T0 = R.to_micros("2024-01-01 00:00:00") + 48 * R.HOUR_US


@register("load_device_slice", with_views(f"""
SELECT {CANON_SQL} FROM trace WHERE device_id = 3 AND "timestamp" BETWEEN {S6_T0} AND {S6_T0 + 72 * R.HOUR_US}""",
    "trace"))
def q_load_device_slice(spark, sf):
    return R.load_device_slice(spark, _split(spark, sf), 3, start_hour=48, duration_hours=72,
                               base="2024-01-01 00:00:00")


@register("split_by_device", with_views("""
SELECT device_id, count(*) AS requests FROM trace GROUP BY 1""", "trace"))
def q_split_by_device(spark, sf):
    return spark.read.parquet(_split(spark, sf)).groupBy("device_id").agg(F.count(F.lit(1)).alias("requests"))


S10_T0 = R.to_micros("2024-01-01 00:00:00")


@register("split_by_day", with_views(f"""
SELECT device_id, ("timestamp" - {S10_T0}) // 86400000000 AS day, count(*) AS requests
FROM trace WHERE "timestamp" >= {S10_T0} GROUP BY 1, 2""", "trace"))
def q_split_by_day(spark, sf):
    p = W.split_by_day(V.trace(spark, sf), scratch_path(spark, "by-day"), "2024-01-01 00:00:00")
    return (spark.read.parquet(p).groupBy("device_id", F.col("day").cast("long").alias("day"))
            .agg(F.count(F.lit(1)).alias("requests")))


GRID_BASE = "2024-01-01 00:00:00"
GRID_SQL = f"""
, s AS (SELECT unnest(generate_series(0, 359)) AS k),
  g AS (SELECT {S10_T0} + s.k * 7200000000 AS slice_start, t.* FROM s JOIN trace t
        ON t."timestamp" BETWEEN {S10_T0} + s.k * 7200000000 AND {S10_T0} + (s.k + 1) * 7200000000)"""


def _grid(spark, sf):
    return R.load_device_grid(V.trace(spark, sf).select(*CANON), range(8), n_hours=720, base=GRID_BASE)


@register("load_device_grid", with_views(GRID_SQL + f"\nSELECT slice_start, {CANON_SQL} FROM g", "trace"))
def q_load_device_grid(spark, sf):
    return _grid(spark, sf).select("slice_start", *CANON)


@register("slice_report", with_views(GRID_SQL + """
SELECT slice_start, device_id, count(*) AS requests,
       count(*) FILTER (WHERE opcode = 'R') AS reads, count(*) FILTER (WHERE opcode = 'W') AS writes,
       strftime(make_timestamp(min("timestamp")), '%Y-%m-%d %H:%M:%S.%f') AS time_min,
       strftime(make_timestamp(max("timestamp")), '%Y-%m-%d %H:%M:%S.%f') AS time_max
FROM g GROUP BY 1, 2""", "trace"))
def q_slice_report(spark, sf):
    s = summary.trace_summary(_grid(spark, sf), keys=["slice_start", "device_id"],
                              extra=[F.count(F.lit(1)).alias("requests")])
    return s.select("slice_start", "device_id", "requests", "reads", "writes", "time_min", "time_max")


@register("sample_n_rows", with_views(f"""
, r AS (SELECT {CANON_SQL}, row_number() OVER (ORDER BY "timestamp", device_id, opcode, "offset", "length") - 1 AS seq
        FROM trace),
  h AS (SELECT *, CAST('0x' || substr(md5('42:' || seq), 1, 15) AS BIGINT) AS h, count(*) OVER () AS n FROM r),
  k AS (SELECT *, row_number() OVER (ORDER BY h, seq) - 1 AS rk FROM h)
SELECT {CANON_SQL} FROM k WHERE rk < CAST(trunc(n * CAST(0.1 AS DOUBLE)) AS BIGINT)""", "trace"))
def q_sample_n_rows(spark, sf):
    s = W.sample_n_rows(V.trace(spark, sf).select(*CANON), nrows=None, rate=0.1, seed=42)
    p = W.write_csv(s, scratch_path(spark, "sample-csv"), header=True)
    return spark.read.schema(R.CANONICAL).option("header", "true").csv(p)


@register("write_annotated_trace", with_views(volume("floor") + """
, f AS (SELECT seq, arg_max(distance, block) AS rd FROM v WHERE acc = 2 GROUP BY seq)
SELECT device_id, opcode, "offset", "length", "timestamp", seq, "offset" // 4096 AS blk_id,
       ("offset" + "length") // 4096 AS end_blk_id, coalesce(f.rd, -1) AS first_rd
FROM r LEFT JOIN f USING (seq)""", "trace"))
def q_write_annotated_trace(spark, sf):
    a = reuse.annotate_first_reuse(V.trace(spark, sf), V.TRACE_ORDER)
    p = W.write_annotated_trace(a, scratch_path(spark, "annotated"))
    return spark.read.parquet(p).select(*a.columns)


@register("write_features", with_views(A15_SQL + """
SELECT * REPLACE (round(io_size_std, 6) AS io_size_std, round(response_time_std, 3) AS response_time_std)
FROM a15""", "trace"))
def q_write_features(spark, sf):
    f = features.device_features(V.trace(spark, sf), V.TRACE_ORDER)
    p = W.write_features(f, scratch_path(spark, "features"))
    return _round_std(W.read_features(spark, p, f.schema))
