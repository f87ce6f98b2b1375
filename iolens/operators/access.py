"""Block access counts and access-pattern frames.

Explode-then-aggregate: each request becomes one row per touched block and is
counted right away (partial aggregation before the shuffle), so the exploded
rows never meet a global sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iolens.functions.blocks import explode_blocks, idiv
from iolens.functions.time import time_floor
from iolens.operators import cdf
from iolens.operators.cdf import join_on_keys
from iolens.plans.order import BKT, join_null_safe, materialized, time_buckets
from iolens.sources.readers import normalize_sector

# Number of log-spaced edges of the access histogram; ranks.
LOG_EDGES = 17


def block_access_counts(df: DataFrame, mode: str = "cover", keys=()) -> DataFrame:
    """Accesses per (device, block)."""
    keys = list(keys)
    ex = explode_blocks(df.select(*dict.fromkeys(keys + ["device_id", "offset", "length"])), mode)
    k = list(dict.fromkeys(keys + ["device_id", "block"]))
    return ex.groupBy(*k).agg(F.count(F.lit(1)).alias("accesses"))


def access_summary(counts: DataFrame, keys=(), col: str = "accesses") -> DataFrame:
    """Unique blocks and min / max / mean accesses per block."""
    keys = list(keys)
    return counts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("unique_blocks"), F.min(col).alias("min_accesses"),
        F.max(col).alias("max_accesses"), (F.sum(col) / F.count(F.lit(1))).alias("mean_accesses"))


def access_count_distribution(counts: DataFrame, keys=()) -> DataFrame:
    """Access count -> number of blocks with that count."""
    return counts.groupBy(*list(keys), "accesses").agg(F.count(F.lit(1)).alias("blocks"))


def access_histogram_log(counts: DataFrame, bins: int = LOG_EDGES - 1, keys=()) -> DataFrame:
    """Blocks per log-spaced bin of the access count, edges from min to max
    (end edges pinned to the exact min and max, last bin closed)."""
    keys = list(keys)
    dist = materialized(access_count_distribution(counts, keys))  # one row per distinct count
    mm = dist.groupBy(*keys).agg(F.min("accesses").alias("mn"), F.max("accesses").alias("mx"))
    l0, l1 = F.log10(F.col("mn")), F.log10(F.col("mx"))

    def edge(i):
        return (F.when(i == 0, F.col("mn").cast("double")).when(i == bins, F.col("mx").cast("double"))
                .otherwise(F.pow(F.lit(10.0), i * ((l1 - l0) / F.lit(float(bins))) + l0)))
    b = mm.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    b = b.select(*keys, "bin", edge(F.col("bin")).alias("lo"), edge(F.col("bin") + 1).alias("hi"))
    # `bins` rows a key beside one row per distinct count: joined on the keys
    j = join_on_keys(dist, b, keys)
    inside = (F.col("accesses") >= F.col("lo")) & ((F.col("accesses") < F.col("hi")) |
                                                   ((F.col("bin") == bins - 1) & (F.col("accesses") <= F.col("hi"))))
    n = j.filter(inside).groupBy(*keys, "bin").agg(F.sum("blocks").alias("blocks"))
    return (join_null_safe(b, n, [*keys, "bin"], "left")
            .select(*keys, "bin", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"),
                    F.coalesce("blocks", F.lit(0).cast("long")).alias("blocks")))


def access_nearest_rank(counts: DataFrame, ps=(0.9, 0.99), keys=()) -> DataFrame:
    """Percentiles of the access count as sorted[int(n*p)] (0-based, no interpolation)."""
    keys = list(keys)
    h = cdf.histogram_of(counts, "accesses", keys)
    n = materialized(h.groupBy(*keys).agg(F.sum("cnt").alias("__n")))  # a row a key
    out = n.drop("__n") if keys else None
    for p in ps:
        ranks = n.select(*keys, F.least((F.col("__n") * F.lit(float(p))).cast("long"), F.col("__n") - 1).alias("__rank")).filter("__n > 0")
        at = cdf.value_at_rank(h, ranks, keys).select(*keys, F.col("__v").alias(f"p{round(p * 100):d}"))
        out = at if out is None else join_on_keys(out, at, keys)
    return out


def access_count_cdf(counts: DataFrame, keys=()) -> DataFrame:
    """Sorted access counts, row i at (i+1)/n, histogram form."""
    return cdf.index_cdf(counts, "accesses", keys, out="accesses", one_based=True)


def _names(*cols) -> list:
    return list(dict.fromkeys(cols))


def access_space(df: DataFrame, mode: str = "cover", keys=()) -> DataFrame:
    """(timestamp, device, block) for every access."""
    return explode_blocks(df.select(*_names(*keys, "device_id", "offset", "length", "timestamp")), mode) \
        .select(*_names(*keys, "timestamp", "device_id", "block"))


def access_arrival(df: DataFrame, ranks: DataFrame, mode: str = "cover", keys=()) -> DataFrame:
    """(timestamp, device, block, first-arrival rank) for every access. Ranks
    are one row per block. They are copied to the stretches of time that visit a
    block, and accesses meet them by (block, stretch): a hot block's accesses are as
    many joins as it has stretches, each about a bucket's rows."""
    by = _names(*keys, "device_id", "block")
    o = time_buckets(df.select(*_names(*keys, "device_id", "offset", "length", "timestamp")), "timestamp")
    ex = explode_blocks(o.df, mode).select(*_names(*by, "timestamp"), BKT)
    visits = join_null_safe(ex.select(*by, BKT).distinct(), ranks.select(*by, "rank"), by)
    return join_null_safe(ex, visits, [*by, BKT]).select(*_names(*keys, "timestamp", "device_id", "block", "rank"))


def access_pattern_sector(df: DataFrame, mode: str = "cover", keys=()) -> DataFrame:
    """(timestamp, device, block) for every access of a sector trace."""
    return access_space(normalize_sector(df, keys), mode, keys)


def access_raw_offset(df: DataFrame, keys=()) -> DataFrame:
    """(time in seconds, raw offset) per request of a sector trace."""
    return df.select(*keys, F.col("Timestamp").alias("time_s"), F.col("Offset").alias("offset"))


def access_raw_offset_summary(df: DataFrame, keys=()) -> DataFrame:
    """X4 statistics: accesses per raw offset -> unique / min / max / mean."""
    keys = list(keys)
    per = df.groupBy(*keys, F.col("Offset").alias("offset")).agg(F.count(F.lit(1)).alias("accesses"))
    return access_summary(per, keys).withColumnRenamed("unique_blocks", "unique_offsets")


def access_heatgrid(df: DataFrame, time_bin_s: int = 3600, block_bin: int = 1024,
                    mode: str = "cover", keys=()) -> DataFrame:
    """Accesses per (device, time bin, block bin) -- the scatter of X1-X4 at
    a size a chart can hold."""
    ex = explode_blocks(df.select(*_names(*keys, "device_id", "offset", "length", "timestamp")), mode)
    return ex.groupBy(*_names(*keys, "device_id"), time_floor("timestamp", time_bin_s).alias("time_bin"),
                      idiv("block", block_bin).alias("block_bin")).agg(F.count(F.lit(1)).alias("accesses"))

