"""Feature tables for clustering.

Inter-arrival times (W10) are computed per device over the whole trace first
and only then grouped, as the reference does (diff before windowing). The trace
is not numbered for them, so no step writes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iolens.functions.blocks import op_indicator
from iolens.operators.cdf import join_on_keys
from iolens.operators.reuse import inter_arrival

# Feature columns of the two tables and the window width (1 h in us).
DEVICE_FEATURES = ("io_count", "io_size_avg", "io_size_std", "read_write_ratio",
                   "response_time_avg", "response_time_std")
WINDOW_FEATURES = ("avg_io_count", "avg_io_size", "io_size_std", "read_write_ratio",
                   "avg_response_time", "interval_mean", "interval_std")
WINDOW_US = 3600 * 1000 * 1000


def _std0(c):
    # pandas sample std, forced to 0 for a single row
    return F.coalesce(F.stddev_samp(c), F.lit(0.0))


def _mean(c):
    return F.sum(c) / F.count(c)


def _with_ia(df: DataFrame, order, keys) -> DataFrame:
    return inter_arrival(df, order, keys, extra=("opcode", "length"))


def device_features(df: DataFrame, order, keys=("device_id",)) -> DataFrame:
    """Per device: count, mean/std length, read share, mean/std inter-arrival."""
    keys = list(keys)
    t = _with_ia(df, order, keys).withColumn("__op", op_indicator())
    return t.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("io_count"),
        _mean(F.col("length").cast("long")).alias("io_size_avg"),
        _std0("length").alias("io_size_std"),
        _mean("__op").alias("read_write_ratio"),
        _mean("inter_arrival").alias("response_time_avg"),
        _std0("inter_arrival").alias("response_time_std"))


def window_features(df: DataFrame, order, keys=("device_id",), window_us: int = WINDOW_US) -> DataFrame:
    """Per fixed time window: count, mean/std length, read share, mean
    inter-arrival (reported twice, as the reference does) and its std."""
    keys = list(keys)
    t = _with_ia(df, order, keys).withColumn("__op", op_indicator())
    w = (F.col("timestamp") - F.pmod("timestamp", F.lit(window_us))) / F.lit(window_us)
    return t.groupBy(*keys, w.cast("long").alias("time_window")).agg(
        F.count(F.lit(1)).alias("avg_io_count"),
        _mean(F.col("length").cast("long")).alias("avg_io_size"),
        _std0("length").alias("io_size_std"),
        _mean("__op").alias("read_write_ratio"),
        _mean("inter_arrival").alias("avg_response_time"),
        _mean("inter_arrival").alias("interval_mean"),
        _std0("inter_arrival").alias("interval_std"))


def standardize(df: DataFrame, cols, keys=(), prefix: str = "z_") -> DataFrame:
    """M1: z-score with the population std; a zero-variance column gives 0.
    The column statistics are one row, joined to every row on the keys."""
    cols = list(cols)
    keys = list(keys)
    stats = df.groupBy(*keys).agg(*[F.avg(c).alias(f"__m_{c}") for c in cols],
                                  *[F.stddev_pop(c).alias(f"__s_{c}") for c in cols])
    j = join_on_keys(df, stats, keys)
    out = []
    for c in cols:
        s = F.col(f"__s_{c}")
        out.append(F.when(s.isNull() | (s == 0), F.lit(0.0))
                   .otherwise((F.col(c) - F.col(f"__m_{c}")) / s).alias(prefix + c))
    others = [c for c in df.columns if c not in cols]
    return j.select(*others, *out)
