"""Trace summaries (A1, A2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iolens.functions.blocks import bytes_to_kb, bytes_to_mb
from iolens.functions.time import micros_to_datetime


def _ratios(reads, writes):
    total = reads + writes
    return (F.when(total > 0, reads / total).otherwise(F.lit(0.0)),
            F.when(total > 0, writes / total).otherwise(F.lit(0.0)))


def trace_summary(df: DataFrame, keys=(), extra=()) -> DataFrame:
    """A1: read/write counts and shares, length range (KB), offset range (MB), time range;
    ``extra`` named aggregates ride along in the same pass."""
    keys = list(keys)
    a = df.groupBy(*keys).agg(
        F.count(F.when(F.col("opcode") == "R", 1)).alias("reads"),
        F.count(F.when(F.col("opcode") == "W", 1)).alias("writes"),
        F.min("length").alias("_lmin"), F.max("length").alias("_lmax"),
        F.min("offset").alias("_omin"), F.max("offset").alias("_omax"),
        F.min("timestamp").alias("_tmin"), F.max("timestamp").alias("_tmax"), *extra)
    rr, wr = _ratios(F.col("reads"), F.col("writes"))
    more = a.columns[len(a.columns) - len(extra):] if extra else []
    return a.select(
        *keys, *more, "reads", "writes", rr.alias("read_ratio"), wr.alias("write_ratio"),
        bytes_to_kb("_lmin").alias("length_min_kb"), bytes_to_kb("_lmax").alias("length_max_kb"),
        bytes_to_mb("_omin").alias("offset_min_mb"), bytes_to_mb("_omax").alias("offset_max_mb"),
        micros_to_datetime("_tmin").alias("time_min"), micros_to_datetime("_tmax").alias("time_max"))


def sector_trace_summary(df: DataFrame, keys=()) -> DataFrame:
    """A2: the same for a sector trace in native units (0 = read, 1 = write; Q5)."""
    keys = list(keys)
    a = df.groupBy(*keys).agg(
        F.count(F.when(F.col("IOType") == 0, 1)).alias("reads"),
        F.count(F.when(F.col("IOType") == 1, 1)).alias("writes"),
        F.min("Size").alias("size_min"), F.max("Size").alias("size_max"),
        F.min("Offset").alias("offset_min"), F.max("Offset").alias("offset_max"),
        F.min("Timestamp").alias("time_min"), F.max("Timestamp").alias("time_max"))
    rr, wr = _ratios(F.col("reads"), F.col("writes"))
    return a.select(*keys, "reads", "writes", rr.alias("read_ratio"), wr.alias("write_ratio"),
                    "size_min", "size_max", "offset_min", "offset_max", "time_min", "time_max")
