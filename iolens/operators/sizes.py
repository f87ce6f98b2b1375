"""Request-size distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iolens.operators import cdf

SMALL_REQUEST_BYTES = 4096  # fixed value: the "4K" mark


def small_request_share(df: DataFrame, keys=(), op: str = "opcode", size: str = "length") -> DataFrame:
    """Percent of requests with size <= 4 KB, per op."""
    keys = list(keys)
    return df.groupBy(*keys, op).agg(
        (F.count(F.when(F.col(size) <= SMALL_REQUEST_BYTES, 1)) / F.count(F.lit(1)) * F.lit(100.0))
        .alias("small_pct"))


def size_p99(df: DataFrame, keys=(), op: str = "opcode", size: str = "length", per_kb: float = 1024.0, p: float = 0.99) -> DataFrame:
    """A10: P99 of request size in KB per op, linear interpolation, by radix selection on
    the counts of whole sizes (``per_kb`` of them make a KB: 2 for sectors). An absent op has no row."""
    by = [*keys, op]
    return cdf.histogram_quantile(cdf.histogram_of(df, size, by), p, by, out="p99_kb", scale=per_kb)


def size_cdf_sampled(df: DataFrame, keys=(), op: str = "opcode", points: int = 1000) -> DataFrame:
    """Request-size CDF per op, 1000 evenly spaced ranks when larger."""
    return cdf.sampled_cdf(df, "length", list(keys) + [op], points, out="length")


def size_cdf_percent(df: DataFrame, keys=(), op: str = "opcode", sector_units: bool = False) -> DataFrame:
    """Size in KB per op, row i at 100*i/(n-1), histogram form."""
    kb = (F.col("Size") / F.lit(2.0)) if sector_units else (F.col("length") / F.lit(1024.0))
    return cdf.percent_cdf(df.withColumn("__kb", kb), "__kb", list(keys) + [op], out="size_kb")
