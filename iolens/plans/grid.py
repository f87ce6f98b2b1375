"""Regular bin grids for gap filling, built on the executors.

A per-key range [lo, hi] is expanded in two steps (coarse chunks, then bins
inside a chunk) so that no single row carries one huge array and the
expansion is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BINS = 4096


def fill_grid(bounds: DataFrame, keys, lo: str, hi: str, step: int, out: str) -> DataFrame:
    """Rows (keys..., out) for out = lo, lo+step, ..., hi for every bounds row."""
    keys = list(keys)
    span = CHUNK_BINS * step
    nchunks = ((F.col(hi) - F.col(lo)) / F.lit(span)).cast("long")
    c = bounds.select(*keys, lo, hi, F.explode(F.sequence(F.lit(0).cast("long"), nchunks)).alias("__chunk"))
    c = c.repartition(*keys, "__chunk")
    start = F.col(lo) + F.col("__chunk") * F.lit(span)
    end = F.least(start + F.lit(span - step), F.col(hi))
    return c.select(*keys, F.explode(F.sequence(start, end, F.lit(step).cast("long"))).alias(out))
