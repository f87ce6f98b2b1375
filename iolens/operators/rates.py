"""Request rates over time.

Bins are exact integer arithmetic on epoch microseconds. Missing bins, where
an operator's reference resamples to a regular index, are generated on the
executors and left-joined, so they appear as rows with null values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iolens.functions.time import time_floor, unit_micros
from iolens.operators.cdf import join_on_keys
from iolens.plans.grid import fill_grid
from iolens.plans.order import join_null_safe, materialized

DAY_US = 86_400_000_000


def requests_per_unit(df: DataFrame, unit="second", keys=(), ts: str = "timestamp") -> DataFrame:
    """A3: requests per bin, in thousands (kIOPS for 1-s bins)."""
    keys = list(keys)
    return (df.groupBy(*keys, time_floor(ts, unit).alias("bin_start"))
            .agg((F.count(F.lit(1)) / F.lit(1000.0)).alias("kreq")))


def mean_rate_resampled(df: DataFrame, unit="second", keys=(), ts: str = "timestamp") -> DataFrame:
    """A4: A3 on a regular grid of the same unit; empty bins are rows with null mean."""
    keys = list(keys)
    a3 = materialized(requests_per_unit(df, unit, keys, ts))  # read for the bounds and for the bins
    bounds = a3.groupBy(*keys).agg(F.min("bin_start").alias("lo"), F.max("bin_start").alias("hi"))
    grid = fill_grid(bounds, keys, "lo", "hi", unit_micros(unit), "bin_start")
    return (join_null_safe(grid, a3, keys + ["bin_start"], "left")
            .select(*keys, "bin_start", F.col("kreq").alias("mean_kreq")))


def iops_mean_peak(df: DataFrame, interval_s: int = 10, keys=(), ts: str = "timestamp") -> DataFrame:
    """A5: counts per non-empty second, then per interval bin their mean and max.

    Bins are anchored at midnight of the first day (per key); bins without any
    request are rows with null mean and peak.
    """
    keys = list(keys)
    step = unit_micros(interval_s)
    per_sec = materialized(df.groupBy(*keys, time_floor(ts, "second").alias("sec")).agg(F.count(F.lit(1)).alias("n")))
    anchor = per_sec.groupBy(*keys).agg(F.min("sec").alias("__first"), F.max("sec").alias("__last"))
    anchor = anchor.withColumn("__day0", F.col("__first") - F.pmod("__first", F.lit(DAY_US)))
    def binned(c):
        return F.col(c) - F.pmod(F.col(c) - F.col("__day0"), F.lit(step))
    j = join_on_keys(per_sec, anchor, keys)
    agg = j.groupBy(*keys, binned("sec").alias("bin_start")).agg(
        (F.sum("n") / F.count(F.lit(1))).alias("mean_iops"), F.max("n").alias("peak_iops"))
    bounds = anchor.select(*keys, binned("__first").alias("lo"), binned("__last").alias("hi"))
    grid = fill_grid(bounds, keys, "lo", "hi", step, "bin_start")
    return join_null_safe(grid, agg, keys + ["bin_start"], "left")


def interval_count_avg_peak(df: DataFrame, interval_s: int = 60, keys=(), ts: str = "timestamp") -> DataFrame:
    """Requests per interval (epoch-anchored), with the mean and max over intervals
    (per key). The two scalars are a per-key aggregate joined back."""
    keys = list(keys)
    c = df.groupBy(*keys, time_floor(ts, interval_s).alias("bin_start")).agg(
        F.count(F.lit(1)).alias("requests"))
    s = c.groupBy(*keys).agg((F.sum("requests") / F.count(F.lit(1))).alias("avg_requests"),
                             F.max("requests").alias("peak_requests"))
    return join_on_keys(c, s, keys).select(*keys, "bin_start", "requests", "avg_requests", "peak_requests")


def device_totals(df: DataFrame) -> DataFrame:
    """Requests per device, ordered by device."""
    return df.groupBy("device_id").agg(F.count(F.lit(1)).alias("requests")).orderBy("device_id")


def busiest_device_rate(df: DataFrame, unit="second", ts: str = "timestamp") -> DataFrame:
    """A3 for the device with most requests (ties: lowest id), no gap filling."""
    # one (device, bin) count serves the totals and the rate
    a3 = materialized(df.groupBy("device_id", time_floor(ts, unit).alias("bin_start")).agg(F.count(F.lit(1)).alias("__n")))
    top = (a3.groupBy("device_id").agg(F.sum("__n").alias("t")).orderBy(F.desc("t"), F.asc("device_id")).limit(1)
           .select("device_id"))
    one = join_null_safe(a3, top, ["device_id"], "left_semi", broadcast=True)
    return one.select("device_id", "bin_start", (F.col("__n") / F.lit(1000.0)).alias("kreq"))


def hourly_mean_size(df: DataFrame, keys=(), ts: str = "timestamp") -> DataFrame:
    """Mean request length per hour."""
    keys = list(keys)
    return (df.groupBy(*keys, time_floor(ts, "hour").alias("hour"))
            .agg((F.sum(F.col("length").cast("long")) / F.count(F.lit(1))).alias("mean_size")))
