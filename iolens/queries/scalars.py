"""Projection / scalar-function queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iolens.functions import blocks as B
from iolens.functions import time as T
from iolens.queries import register
from iolens.queries.sqlparts import block_bounds
from iolens.sources import views as V
from iolens.sources.views import with_views

TXT = "strftime(make_timestamp({c}), '%Y-%m-%d %H:%M:%S.%f')"


@register("micros_to_datetime", with_views(f"""
SELECT tie, "timestamp", {TXT.format(c='"timestamp"')} AS datetime FROM trace""", "trace"))
def q_micros_to_datetime(spark, sf):
    return V.trace(spark, sf).select("tie", "timestamp", T.micros_to_datetime("timestamp").alias("datetime"))


@register("datetime_to_micros", with_views(f"""
SELECT tie, "timestamp",
       epoch_us(CAST({TXT.format(c='"timestamp"')} AS TIMESTAMP)) AS micros,
       epoch_us(CAST(strftime(make_timestamp("timestamp"), '%Y-%m-%d %H:%M:%S') AS TIMESTAMP)) AS micros_no_fraction
FROM trace""", "trace"))
def q_datetime_to_micros(spark, sf):
    t = V.trace(spark, sf)
    no_frac = F.date_format(F.timestamp_micros("timestamp"), "yyyy-MM-dd HH:mm:ss")
    return t.select("tie", "timestamp", T.datetime_to_micros(T.micros_to_datetime("timestamp")).alias("micros"),
                    T.datetime_to_micros(no_frac).alias("micros_no_fraction"))


@register("block_of_offset", with_views("""
SELECT tie, "offset", "offset" // 4096 AS block, "offset" // 512 AS block_512 FROM trace""", "trace"))
def q_block_of_offset(spark, sf):
    return V.trace(spark, sf).select("tie", "offset", B.block_of_offset().alias("block"),
                                     B.block_of_offset(block_size=512).alias("block_512"))


@register("end_block", with_views("""
SELECT tie, ("offset" + "length") // 4096 AS end_block FROM trace""", "trace"))
def q_end_block(spark, sf):
    return V.trace(spark, sf).select("tie", B.end_block().alias("end_block"))


def _explode_sql(mode):
    s, last = block_bounds(mode)
    return with_views(f"""
SELECT tie, device_id, unnest(generate_series(__s, __l)) AS block
FROM (SELECT *, {s} AS __s, {last} AS __l FROM trace) WHERE __s <= __l""", "trace")


def _explode(mode):
    def q(spark, sf):
        return B.explode_blocks(V.trace(spark, sf), mode).select("tie", "device_id", "block")
    q.__name__ = f"q_explode_blocks_{mode}"
    return q


for _m in B.MODES:
    register(f"explode_blocks_{_m}", _explode_sql(_m))(_explode(_m))


@register("op_filter", with_views("""SELECT * FROM trace WHERE opcode = 'R'""", "trace"))
def q_op_filter(spark, sf):
    return B.op_filter(V.trace(spark, sf), "R")


@register("op_indicator", with_views("""
SELECT tie, opcode, CAST(CASE opcode WHEN 'R' THEN 1 WHEN 'W' THEN 0 END AS INTEGER) AS op_indicator
FROM trace""", "trace"))
def q_op_indicator(spark, sf):
    return V.trace(spark, sf).select("tie", "opcode", B.op_indicator().alias("op_indicator"))


@register("op_class", with_views("""
SELECT event_id, op_name, CASE WHEN op_name IN (2, 1, 5) THEN 'GET' WHEN op_name IN (4, 3, 6) THEN 'PUT'
       ELSE 'UNKNOWN' END AS op_class FROM object_trace""", "object_trace"))
def q_op_class(spark, sf):
    return V.object_trace(spark, sf).select("event_id", "op_name", B.op_class().alias("op_class"))


@register("size_units", with_views("""
SELECT tie, "length" / CAST(1024 AS DOUBLE) AS length_kb, "length" / CAST(1048576 AS DOUBLE) AS length_mb,
       "offset" / CAST(1048576 AS DOUBLE) AS offset_mb FROM trace""", "trace"))
def q_size_units(spark, sf):
    return V.trace(spark, sf).select("tie", B.bytes_to_kb("length").alias("length_kb"),
                                     B.bytes_to_mb("length").alias("length_mb"),
                                     B.bytes_to_mb("offset").alias("offset_mb"))


@register("size_units_sector", with_views("""
SELECT tie, "Size" / CAST(2 AS DOUBLE) AS size_kb FROM sector_trace""", "sector_trace"))
def q_size_units_sector(spark, sf):
    return V.sector_trace(spark, sf).select("tie", B.sectors_to_kb("Size").alias("size_kb"))


@register("time_floor", with_views("""
SELECT tie, "timestamp" - "timestamp" % 1000000 AS t_second, "timestamp" - "timestamp" % 60000000 AS t_minute,
       "timestamp" - "timestamp" % 3600000000 AS t_hour, "timestamp" - "timestamp" % 10000000 AS t_10s
FROM trace""", "trace"))
def q_time_floor(spark, sf):
    return V.trace(spark, sf).select(
        "tie", T.time_floor("timestamp", "second").alias("t_second"),
        T.time_floor("timestamp", "minute").alias("t_minute"), T.time_floor("timestamp", "hour").alias("t_hour"),
        T.time_floor("timestamp", 10).alias("t_10s"))


@register("range_label", with_views("""
SELECT device_id,
       strftime(make_timestamp(min("timestamp")), '%m%d_%H') || '-' || strftime(make_timestamp(max("timestamp")), '%m%d_%H') AS label,
       strftime(make_timestamp(min("timestamp")), '%m%d_%H') || '-' || strftime(make_timestamp(max("timestamp")), '%H') AS label_short
FROM trace GROUP BY 1""", "trace"))
def q_range_label(spark, sf):
    a = V.trace(spark, sf).groupBy("device_id").agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    return a.select("device_id", T.range_label("lo", "hi").alias("label"),
                    T.range_label("lo", "hi", short=True).alias("label_short"))


@register("drop_bad_ts", with_views("""
SELECT tie, "timestamp" FROM trace WHERE tie % 97 <> 2""", "trace"))
def q_drop_bad_ts(spark, sf):
    t = V.trace(spark, sf)
    txt = t.select("tie", F.when(F.col("tie") % 97 == 2, F.lit("x"))
                   .otherwise(F.col("timestamp").cast("string")).alias("timestamp"))
    return T.drop_bad_ts(txt)


def union_chunks(frames) -> DataFrame:
    """Concatenate chunk frames by column name (row order is not kept)."""
    return reduce(lambda a, b: a.unionByName(b), frames)


@register("union_chunks", with_views("""SELECT * FROM trace""", "trace"))
def q_union_chunks(spark, sf):
    t = V.trace(spark, sf)
    return union_chunks([t.filter(F.col("device_id") < 4), t.filter(F.col("device_id") >= 4)])
