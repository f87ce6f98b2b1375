"""Distribution tables (C1-C5) computed from histograms.

A CDF over billions of rows is never built row by row: rows are first counted
per distinct value (map-side partial aggregation), then a running count over
the distinct values gives every value's first and last rank. Running counts
use the two-level prefix sum, so a key with many distinct values is still
spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from iolens.plans.order import BKT, FB, PLACE, assign_buckets, join_null_safe, materialized, prefix_sum


def join_on_keys(df: DataFrame, small: DataFrame, keys) -> DataFrame:
    """Join a per-key table (one row per key); with no keys, on a constant."""
    keys = list(keys)
    if keys:
        return join_null_safe(df, small, keys)
    return df.withColumn("__one", F.lit(0)).join(
        F.broadcast(small.withColumn("__one", F.lit(0))), "__one").drop("__one")


def cumulative_histogram(df: DataFrame, x, keys=(), out: str = "x", weight: str | None = None,
                         materialize: bool = True) -> DataFrame:
    """(keys, x, cnt, cb, n): cnt rows equal x; cb rows with a smaller value; n rows in key.
    ``weight``: the input is already a histogram with that count column."""
    keys = list(keys)
    xc = F.col(x) if isinstance(x, str) else x
    c = F.sum(weight) if weight else F.count(F.lit(1))
    h = df.groupBy(*keys, xc.alias(out)).agg(c.alias("cnt")).filter(F.col(out).isNotNull())
    # the ranges are written: everything below reads the histogram, not the input
    o = assign_buckets(h, [out], materialize=materialize)
    tot = o.df.groupBy(*keys).agg(F.sum("cnt").alias("n"))
    o = prefix_sum(o, "cnt", keys, seq=out, out="__cum")
    r = o.df.withColumn("cb", (F.col("__cum") - F.col("cnt")).cast("long")).drop("__cum", BKT, FB, PLACE)
    return join_on_keys(r, tot, keys)


def linspace_at(i: Column, n: Column, stop: float) -> Column:
    """Value at index i of numpy.linspace(0, stop, n): i * (stop / (n-1)), last = stop."""
    return (F.when(n == 1, F.lit(0.0))
            .when(i == n - 1, F.lit(float(stop)))
            .otherwise(i * (F.lit(float(stop)) / (n - 1))))


def sampled_cdf(df: DataFrame, x: str, keys=(), points: int = 1000, out: str = "x") -> DataFrame:
    """Sorted values; n > points -> `points` evenly spaced ranks with cdf j/(points-1);
    otherwise every rank i (1-based) with cdf i/n."""
    keys = list(keys)
    h = cumulative_histogram(df, x, keys, out)
    n, cb, cnt, j = F.col("n"), F.col("cb"), F.col("cnt"), F.col("point")
    # a histogram row covers ranks cb .. cb + cnt - 1; the points whose rank falls there
    # follow from the row alone: those near cb / step and (cb + cnt) / step, then tested
    step = (n - 1) / F.lit(float(points - 1))
    rank = F.when(j == points - 1, n - 1).otherwise((j * step).cast("long"))
    near = F.sequence(F.greatest(F.lit(0).cast("long"), F.floor(cb / step) - 1),
                      F.least(F.lit(points - 1).cast("long"), F.ceil((cb + cnt) / step) + 1))
    big = (h.filter(n > points).withColumn("point", F.explode(near))
           .filter((rank >= cb) & (rank < cb + cnt))
           .withColumn("cdf", F.when(j == points - 1, F.lit(1.0)).otherwise(j * F.lit(1.0 / (points - 1)))))
    small = (h.filter(n <= points).withColumn("point", F.explode(F.sequence(cb, cb + cnt - 1)))
             .withColumn("cdf", (j + 1) / n))
    cols = [*keys, j.cast("int").alias("point"), out, "cdf"]
    return big.select(*cols).unionByName(small.select(*cols))


def percent_cdf(df: DataFrame, x: str, keys=(), out: str = "x", stop: float = 100.0) -> DataFrame:
    """C2/C4 histogram form: sorted row i has linspace(0, stop, n)[i]; per value the
    first and last row's position."""
    h = cumulative_histogram(df, x, keys, out)
    last = F.col("cb") + F.col("cnt") - 1
    return h.select(*list(keys), out, "cnt",
                    linspace_at(F.col("cb"), F.col("n"), stop).alias("pct_first"),
                    linspace_at(last, F.col("n"), stop).alias("pct_last"))


def index_cdf(df: DataFrame, x: str, keys=(), out: str = "x", one_based: bool = False) -> DataFrame:
    """C3 (i/n) and C5 ((i+1)/n) histogram form: first and last row's cdf per value."""
    h = cumulative_histogram(df, x, keys, out)
    add = 1 if one_based else 0
    return h.select(*list(keys), out, "cnt",
                    ((F.col("cb") + add) / F.col("n")).alias("cdf_first"),
                    ((F.col("cb") + F.col("cnt") - 1 + add) / F.col("n")).alias("cdf_last"))


#: bits of a value that one pass of ``value_at_rank`` settles
DIGIT_BITS = 16


def value_at_rank(hist: DataFrame, ranks: DataFrame, keys=(), x: str = "__x", cnt: str = "cnt") -> DataFrame:
    """Radix selection. ``hist``: a written value -> count table by key, with long
    values; ``ranks``: one row a key with a 0-based rank ``__rank``. Returns, by key, the value
    there, ``__v``, and how many rows equal to it lie after that rank, ``__after``.

    Each pass counts the rows that share the digits found so far by their next
    digit, at most ``2 ** DIGIT_BITS`` counts a key, and takes the one the rank
    falls in. Nothing is sorted but these counts, and no value list is held."""
    keys = list(keys)
    low, high = hist.agg(F.min(x), F.max(x)).first()
    low, high = (low or 0), (high or 0)
    passes = max(1, -(-(high - low).bit_length() // DIGIT_BITS))
    state = ranks.select(*keys, F.lit(0).cast("long").alias("__v"), F.col("__rank").cast("long").alias("__left"))
    value = F.col(x) - F.lit(low)
    for k in range(passes - 1, -1, -1):
        # a row's digits down to this one, and those of them that are settled
        digits = F.shiftright(value, DIGIT_BITS * k)
        settled = F.shiftright(value, DIGIT_BITS * (k + 1)) if k < passes - 1 else F.lit(0).cast("long")
        rows = hist.select(*keys, settled.alias("__p"), digits.alias("__d"), F.col(cnt).alias("__c"))
        counts = (join_on_keys(rows, state, keys).filter("__p = __v").groupBy(*keys, "__d")
                  .agg(F.sum("__c").alias("__c"), F.first("__left").alias("__left")))
        upto = F.sum("__c").over(Window.partitionBy(*keys).orderBy("__d").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        state = (counts.withColumn("__upto", upto)
                 .filter((F.col("__left") >= F.col("__upto") - F.col("__c")) & (F.col("__left") < F.col("__upto")))
                 .select(*keys, F.col("__d").alias("__v"), (F.col("__left") - F.col("__upto") + F.col("__c")).alias("__left"),
                         (F.col("__upto") - F.col("__left") - 1).alias("__after")))
    return state.select(*keys, (F.col("__v") + F.lit(low)).alias("__v"), "__after")


def histogram_of(df: DataFrame, x, keys=()) -> DataFrame:
    """The written value -> count table of a long column, ``__x`` and ``cnt``, nulls left out."""
    xc = F.col(x) if isinstance(x, str) else x
    return materialized(df.groupBy(*list(keys), xc.cast("long").alias("__x")).agg(F.count(F.lit(1)).alias("cnt"))
                        .filter(F.col("__x").isNotNull()))


def histogram_quantile(hist: DataFrame, q: float, keys=(), out: str = "quantile", scale: float = 1.0, extra=()) -> DataFrame:
    """Exact quantile (linear interpolation at position (n - 1) * q) of ``__x / scale``
    per key of a ``histogram_of``; ``extra`` aggregates of the histogram ride along."""
    keys = list(keys)
    sums = hist.groupBy(*keys).agg(F.sum("cnt").alias("__n"), *extra)
    sums = materialized(sums)  # a row a key
    pos = (F.col("__n") - 1).cast("double") * F.lit(float(q))
    at = materialized(value_at_rank(hist, sums.select(*keys, F.floor(pos).alias("__rank")), keys))
    # the next rank's value is the same, or the next larger one
    above = join_on_keys(hist, at.select(*keys, F.col("__v").alias("__low")), keys).groupBy(*keys).agg(
        F.min(F.when(F.col("__x") > F.col("__low"), F.col("__x"))).alias("__next"))
    j = join_on_keys(join_on_keys(at, above, keys), sums, keys)
    lo = F.col("__v").cast("double") / F.lit(scale)
    hi = F.when(F.col("__after") > 0, F.col("__v")).otherwise(F.coalesce("__next", "__v")).cast("double") / F.lit(scale)
    return j.withColumn(out, lo + (hi - lo) * (pos - F.floor(pos))).drop("__v", "__after", "__next", "__n")


def histogram_stats(df: DataFrame, x: str, q: float, keys=(), out: str = "quantile", extra=()) -> DataFrame:
    """Exact quantile of a long column ``x`` per key plus aggregates over its histogram
    (columns __x and cnt available to ``extra``)."""
    return histogram_quantile(histogram_of(df, x, keys), q, keys, out, extra=extra)
