"""Total order without a single-partition window.

The reference uses the row position of a time-sorted file as its clock. On
Spark a row number over an unpartitioned window would put the whole trace in
one task, so positions are built in two levels:

1. rows are range-partitioned on the *full* order key, sorted inside each
   partition and written once, with the partition's number (``_fb``, the fine
   bucket) and the row's place in it. The input is read twice, for Spark's sample
   of the ranges and for the shuffle; it is not counted first. Fine buckets are contiguous ranges of the
   order; a hot timestamp is split on the following order columns, and nulls
   sort first, as everywhere in Spark, whatever the size.
2. the written table's rows are counted by fine bucket: at most ``MAX_BUCKETS``
   numbers. A position is the place in the fine bucket plus the number of rows in
   all earlier ones, a lookup in an array of that many entries: no join, no window.
   Only if a fine bucket turns out larger than a coarse one may be is the written
   table dealt again, into as many ranges as its known size asks for.

A trace that Spark estimates as small is counted first; if it fits one coarse
bucket it is one sorted range, neither sampled nor written.

Coarse buckets (``_bkt``) are runs of consecutive fine buckets, about
``rows_per_bucket`` rows, from the same counts. Per-key sequences (a block's previous access, its
access rank) use windows partitioned by (key, coarse bucket); the first row of
a key inside a bucket takes its predecessor from a per-(key, bucket) summary
table, so one hot key is still spread over all buckets. Keys may be null: all
joins on keys are null-safe.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BKT = "_bkt"
FB = "_fb"
PLACE = "_place"
FINE_SPLIT = 2
MAX_BUCKETS = 100_000
SMALL_BYTES = 64 << 20
DEFAULT_ROWS_PER_BUCKET = 2_000_000
CONF_ROWS_PER_BUCKET = "iolens.order.rowsPerBucket"
_PLACE_BITS = 33  # fixed value: bits of monotonically_increasing_id that count rows inside a partition


@dataclass
class Ordered:
    """A frame with a bucket column and (optionally) a global position column."""
    df: DataFrame
    nb: int          # number of buckets; 1 means the bucket column is constant
    order: tuple
    n: int = -1      # number of rows when known
    before: tuple = ()  # rows before each fine bucket (``assign_buckets``)


def rows_per_bucket(df: DataFrame, override: int | None = None) -> int:
    if override:
        return int(override)
    v = df.sparkSession.conf.get(CONF_ROWS_PER_BUCKET, None)
    return int(v) if v else DEFAULT_ROWS_PER_BUCKET


def materialized(df: DataFrame) -> DataFrame:
    """Write a derived frame once as Parquet under the shared checkpoint folder
    and read it back, so its consumers do not each recompute its upstream, and a
    lost executor replays only the read.
    (An eager RDD checkpoint of an uncached frame would compute it twice.)"""
    from iolens.session import scratch_path
    path = scratch_path(df.sparkSession, "materialized")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_null_safe(left: DataFrame, right: DataFrame, keys, how: str = "inner", broadcast: bool = False) -> DataFrame:
    """Equi-join on ``keys`` where null equals null; ``right``'s key columns are dropped."""
    keys = list(keys)
    named = right.select(*[F.col(f"`{k}`").alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(F.col(f"__r_{k}"))
        cond = c if cond is None else cond & c
    return left.join(F.broadcast(named) if broadcast else named, cond, how).drop(*[f"__r_{k}" for k in keys])


def _placed(df: DataFrame, order, ranges: int | None) -> DataFrame:
    """The frame in order, written, with each row's fine bucket and place in it."""
    cols = [F.col(f"`{c}`") for c in order]
    # without a number the session's is taken, and small neighbouring ranges are joined at run time
    dealt = df.repartitionByRange(ranges, *cols) if ranges else df.repartitionByRange(*cols)
    return materialized(dealt.sortWithinPartitions(*cols)
                        .withColumn(FB, F.spark_partition_id().cast("long"))
                        .withColumn(PLACE, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))))


def _looks_small(df: DataFrame) -> bool:
    """Whether Spark estimates the input at ``SMALL_BYTES`` at most, so that counting it costs little."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= SMALL_BYTES


def _counts(placed: DataFrame) -> list[int]:
    """Rows of every fine bucket; a number for each, so at most ``MAX_BUCKETS``."""
    got = {r[0]: r[1] for r in placed.groupBy(FB).agg(F.count(F.lit(1))).collect()}
    return [got.get(k, 0) for k in range(max(got, default=-1) + 1)]


def looked_up(values, at) -> Column:
    """``values[at]`` for a list of longs, as one literal array."""
    return F.get(F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>"), at.cast("int"))


def assign_buckets(df: DataFrame, order, rpb=None, materialize: bool = False) -> Ordered:
    """Add ``_fb``, ``_bkt`` (long) and ``_place`` (long): buckets are contiguous,
    ordered ranges of ``order`` and ``_place`` is a row's position in its fine
    bucket. The result is a written table: one shuffle, one sort. ``rpb``: rows of a
    coarse bucket, or a function that gives them for a number of rows and the frame that has them.

    ``materialize``: the input is derived (not a plain scan); write it first, as
    sampling its ranges and shuffling it each read it."""
    order = tuple(order)
    if materialize:
        df = materialized(df)
    if _looks_small(df):
        n = df.count()
        if n <= rows_per_bucket(df, rpb(n, df) if callable(rpb) else rpb):
            # one range of a counted size: nothing to sample, nothing to write. All columns
            # are sorted by, so that every evaluation gives a row the same place
            cols = [F.col(f"`{c}`") for c in dict.fromkeys([*order, *(f.name for f in df.schema if not isinstance(f.dataType, T.MapType))])]
            one = df.repartition(1).sortWithinPartitions(*cols).withColumn(PLACE, F.monotonically_increasing_id())
            return Ordered(one.withColumns({FB: F.lit(0).cast("long"), BKT: F.lit(0).cast("long")}), 1, order, n, (0,))
    out = _placed(df, order, None)
    counts = _counts(out)
    n = sum(counts)
    rpb = rows_per_bucket(df, rpb(n, out) if callable(rpb) else rpb)
    ranges = min(MAX_BUCKETS, math.ceil(n / max(1, rpb // FINE_SPLIT)))
    if max(counts, default=0) > rpb and ranges > len(counts):
        out = _placed(out.drop(FB, PLACE), order, ranges)
        counts = _counts(out)
    before = list(accumulate(counts, initial=0))
    # a fine bucket lies in the coarse one of its first row; coarse ones without any are left out
    runs = [b // rpb for b in before[:-1]]
    number = {r: k for k, r in enumerate(sorted(set(runs)))}
    nb = max(1, len(number))
    bucket = looked_up([number[r] for r in runs], F.col(FB)) if nb > 1 else F.lit(0).cast("long")
    return Ordered(out.withColumn(BKT, bucket), nb, order, n, tuple(before[:-1]))


def _running_before(df: DataFrame, value: str, keys, bucket: str, out: str) -> DataFrame:
    """Sum of ``value`` over earlier buckets, per key. ``df`` is small: keys x buckets."""
    w = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long"))


def global_index(df: DataFrame, order, out: str = "seq", rpb=None, materialize: bool = False) -> Ordered:
    """0-based position of every row in ``order`` (W1 ``request_sequence``)."""
    return number_rows(assign_buckets(df, order, rpb, materialize), out)


def _position(o: Ordered) -> Column:
    return looked_up(o.before or [0], F.col(FB)) + F.col(PLACE)


def number_rows(o: Ordered, out: str = "seq") -> Ordered:
    """Positions for the result of ``assign_buckets``; drops its helper columns but ``_bkt``."""
    return Ordered(o.df.withColumn(out, _position(o)).drop(FB, PLACE), o.nb, o.order, o.n)


def rank_in(o: Ordered, order, keys, out: str) -> DataFrame:
    """0-based place of every row among the rows of its ``keys``, for buckets that
    are ranges of ``order`` already: its place in the bucket, after the rows of earlier ones."""
    place = F.row_number().over(Window.partitionBy(*keys, BKT).orderBy(*order)).cast("long") - 1
    if o.nb == 1:
        return o.df.withColumn(out, place)
    base = _running_before(o.df.groupBy(*keys, BKT).agg(F.count(F.lit(1)).alias("__n")), "__n", keys, BKT, "__base").drop("__n")
    ranked = o.df.withColumn("__place", place)  # a join with the small table after the window: the rows are not shuffled for it
    res = join_null_safe(ranked, base, [*keys, BKT], "left", broadcast=not keys)
    return res.withColumn(out, F.col("__place") + F.col("__base")).drop("__place", "__base")


def number_in_cells(df: DataFrame, order, keys, out: str = "seq", rpb=None, fine: bool = False) -> Ordered:
    """0-based position of every row among the rows of its ``keys``. Buckets are
    ranges of (keys, order), so a large cell is spread like a large trace. A cell's
    first position comes from the smallest place by (cell, fine bucket); up to
    ``MAX_BUCKETS`` cells, counted, the table of cells is broadcast. ``fine``: keep
    the fine bucket."""
    keys = list(keys)
    o = assign_buckets(df, [*keys, *order], rpb)
    numbered = Ordered(o.df.withColumn(out, _position(o)).drop(PLACE, *([] if fine else [FB])), o.nb, o.order, o.n, o.before)
    if not keys:
        return numbered
    first = materialized(o.df.groupBy(*keys, FB).agg(F.min(PLACE).alias(PLACE)).withColumn("__first", _position(o))
                         .groupBy(*keys).agg(F.min("__first").alias("__first")))
    res = join_null_safe(numbered.df, first, keys, broadcast=first.count() <= MAX_BUCKETS)
    return Ordered(res.withColumn(out, F.col(out) - F.col("__first")).drop("__first"), o.nb, o.order, o.n, o.before)


def time_buckets(df: DataFrame, col: str, rpb: int | None = None) -> Ordered:
    """The frame as it lies, with buckets that are equal stretches of a numeric
    column: as many as its rows ask for, from one aggregate of that column. Nothing
    is sorted, numbered or written. Nulls have the bucket -1, before all others.
    (A stretch may hold more rows than others; windows by key and bucket spill.)"""
    lo, hi, n = df.agg(F.min(col).cast("double"), F.max(col).cast("double"), F.count(F.lit(1))).first()
    nb = max(1, min(MAX_BUCKETS, math.ceil(n / rows_per_bucket(df, rpb))))
    if nb == 1 or lo is None or hi <= lo:
        return Ordered(df.withColumn(BKT, F.lit(0).cast("long")), 1, (col,), n)
    at = F.floor((F.col(col).cast("double") - F.lit(lo)) * F.lit(nb / (hi - lo)))
    bucket = F.when(F.col(col).isNull(), F.lit(-1)).otherwise(F.least(at, F.lit(nb - 1)))
    return Ordered(df.withColumn(BKT, bucket.cast("long")), nb + 1, (col,), n)


_CARRY = "__carry"


def _with_carry(rows: DataFrame, carry: DataFrame) -> DataFrame:
    """Rows and carry rows (``__carry``), which are null in the columns they lack."""
    return rows.withColumn(_CARRY, F.lit(False)).unionByName(carry.withColumn(_CARRY, F.lit(True)), allowMissingColumns=True)


def prefix_sum(o: Ordered, value, keys=(), seq: str = "seq", out="cum") -> Ordered:
    """Running sum of ``value`` in ``seq`` order per ``keys``, current row included;
    with lists of values and names, several in one pass.

    With several buckets, the totals of a key's earlier buckets enter its bucket as a
    carry row, before all others, so the rows are shuffled once, by (key, bucket)."""
    keys = list(keys)
    values, outs = (value, out) if isinstance(out, list) else ([value], [out])
    tmp = [f"__v{k}" for k in range(len(outs))]
    df = o.df.withColumns({t: F.col(v) if isinstance(v, str) else v for t, v in zip(tmp, values)})
    w = (Window.partitionBy(*keys, BKT).orderBy(F.col(seq).asc_nulls_first())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    run = {c: F.sum(t).over(w) for t, c in zip(tmp, outs)}
    if o.nb > 1:
        base = df.groupBy(*keys, BKT).agg(*[F.sum(t).alias(f"{t}_t") for t in tmp])
        for t in tmp:
            base = _running_before(base, f"{t}_t", keys, BKT, f"{t}_b")
        df = _with_carry(df, base.select(*keys, BKT, *[F.col(f"{t}_b").alias(t) for t in tmp]))
        # the running sum is a sort of the whole frame and its consumers
        # (per-key summaries and windows) read it more than once: write it once
        return Ordered(materialized(df.withColumns(run).filter(~F.col(_CARRY)).drop(_CARRY, *tmp)), o.nb, o.order, o.n)
    return Ordered(df.withColumns(run).drop(*tmp), o.nb, o.order, o.n)


def keyed_prev(o: Ordered, keys, cols, seq: str = "seq", prefix: str = "prev_",
               rank: str | None = None) -> Ordered:
    """Per key, the previous row's ``cols`` in ``seq`` order (null for the first)
    and optionally the 1-based rank of the row inside its key.

    Windows are partitioned by (keys, bucket). What the first row of a key in a
    bucket needs -- the key's last row and row count in earlier buckets -- is built
    by a partial aggregate, one row per (key, bucket), and enters the window as a
    carry row before all others, so the rows are shuffled and sorted once.
    """
    keys = list(keys)
    cols = list(cols)
    part = keys + [BKT]
    w = Window.partitionBy(*part).orderBy(F.col(seq).asc_nulls_first())
    df = o.df
    lags = {prefix + c: F.lag(c).over(w) for c in cols}
    if o.nb == 1:
        df = df.withColumns(lags)
        if rank:
            df = df.withColumn(rank, F.row_number().over(w).cast("long"))
        return Ordered(df, o.nb, o.order, o.n)
    # one primitive aggregate per column keeps this a hash aggregate with
    # map-side combining (a struct-valued max_by would force a sort aggregate)
    last = [(F.max(seq) if c == seq else F.max_by(c, seq)).alias(f"__kl_{c}") for c in cols]
    summ = df.groupBy(*part).agg(F.count(F.lit(1)).alias("__kn"), *last)
    wk = Window.partitionBy(*keys).orderBy(BKT)
    summ = _running_before(summ, "__kn", keys, BKT, "__kbefore")
    carry = (summ.select(*part, "__kbefore", *[F.lag(f"__kl_{c}").over(wk).alias(c) for c in cols])
             .filter("__kbefore > 0"))
    df = _with_carry(df.withColumn("__kbefore", F.lit(None).cast("long")), carry).withColumns(lags)
    if rank:
        before = F.first("__kbefore").over(w)
        df = df.withColumn(rank, (F.row_number().over(w) + F.coalesce(before - 1, F.lit(0))).cast("long"))
    return Ordered(df.filter(~F.col(_CARRY)).drop("__kbefore", _CARRY), o.nb, o.order, o.n)


def lag_in_time(df: DataFrame, order, keys, ts: str, out: str) -> DataFrame:
    """Per key, the previous row's ``ts`` in ``order``, whose first column is
    ``ts`` (null for the first row). Rows are neither numbered nor written: they are
    shuffled once, by key and stretch of time, with one carry row for each of these."""
    keys, order = list(keys), list(order)
    if order[0] != ts:
        raise ValueError("the order begins with the time column")
    o = time_buckets(df, ts)
    w = Window.partitionBy(*keys, BKT).orderBy(*order)
    if o.nb == 1:
        return o.df.withColumn(out, F.lag(ts).over(w)).drop(BKT)
    last = o.df.groupBy(*keys, BKT).agg(F.max(ts).alias("__last"))
    wk = Window.partitionBy(*keys).orderBy(BKT)
    carry = (last.select(*keys, BKT, F.lag("__last").over(wk).alias(ts), F.lag(BKT).over(wk).isNotNull().alias("__some"))
             .filter("__some").drop("__some"))
    w = Window.partitionBy(*keys, BKT).orderBy(F.desc(_CARRY), *order)
    return _with_carry(o.df, carry).withColumn(out, F.lag(ts).over(w)).filter(~F.col(_CARRY)).drop(_CARRY, BKT)
