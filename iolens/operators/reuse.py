"""Block reuse distances.

All of them need the trace's request order. ``global_index`` gives every
request its 0-based position ``seq`` (two-level, see plans/order.py); per-key
predecessors come from ``keyed_prev``, which keeps a hot block or device
spread over time buckets. Running sums of request lengths use ``prefix_sum``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iolens.functions.blocks import (BLOCK_SIZE, block_of_offset, col_floordiv, end_block, explode_blocks,
                                     idiv)
from iolens.operators.cdf import histogram_stats, join_on_keys
from iolens.plans.order import (BKT, FB, Ordered, global_index, join_null_safe, keyed_prev, lag_in_time, materialized,
                                number_in_cells, prefix_sum, rank_in)

TRACE_COLS = ("device_id", "opcode", "offset", "length", "timestamp")


def request_sequence(df: DataFrame, order, out: str = "seq", keys=()) -> DataFrame:
    """0-based position of every request in time order (``keys``: in its cell)."""
    return number_in_cells(df, order, keys, out).df.drop(BKT)


def ordered(df: DataFrame, order, keys=()) -> Ordered:
    """The trace numbered once (``keys``: in each cell). The order-dependent
    operators take it in place of the trace, with the same ``order`` and
    ``keys``, and then neither order nor write the trace again."""
    return number_in_cells(df, order, keys)


def _seq(df, order, cols, keys=()) -> Ordered:
    if isinstance(df, Ordered):
        return df
    keep = list(dict.fromkeys(list(keys) + list(cols) + list(order)))
    return number_in_cells(df.select(*keep), order, keys)


def _with(o: Ordered, df: DataFrame) -> Ordered:
    return Ordered(df, o.nb, o.order, o.n)


def _names(*cols) -> list:
    return list(dict.fromkeys(cols))


def reuse_gap_requests(df: DataFrame, order, mode: str = "count", keys=()) -> DataFrame:
    """Per (device, block), any op: requests since the block's previous access.
    ``keys``: one run per cell, positions restart in each."""
    o = _seq(df, order, TRACE_COLS, keys)
    by = _names(*keys, "device_id", "block")
    ex = _with(o, explode_blocks(o.df, mode).select(*by, "seq", BKT))
    p = keyed_prev(ex, by, ["seq"]).df
    return (p.filter(F.col("prev_seq").isNotNull())
            .select(*by, "seq", (F.col("seq") - F.col("prev_seq")).alias("gap")))


def reuse_gap_by_op(df: DataFrame, order, keys=()) -> DataFrame:
    """Per (op, device, first block): requests since the previous same-op access;
    positions count all requests (``keys``: of the cell)."""
    o = _seq(df, order, TRACE_COLS, keys)
    by = _names(*keys, "opcode", "device_id", "block")
    ex = _with(o, o.df.withColumn("block", block_of_offset()).select(*by, "seq", BKT))
    p = keyed_prev(ex, by, ["seq"]).df
    return (p.filter(F.col("prev_seq").isNotNull())
            .select(*by, "seq", (F.col("seq") - F.col("prev_seq")).alias("gap")))


def reuse_gap_seconds(df: DataFrame, order, unit: int = 512, keys=()) -> DataFrame:
    """W4 (sector trace): per (volume, Offset // 512), any op: seconds since the previous access."""
    o = _seq(df, order, ("VolumeID", "Offset", "Timestamp"), keys)
    by = _names(*keys, "VolumeID", "block")
    ex = _with(o, o.df.withColumn("block", idiv("Offset", unit)).select(*_names(*by, "Timestamp", "seq", BKT)))
    p = keyed_prev(ex, by, ["Timestamp", "seq"]).df
    return (p.filter(F.col("prev_seq").isNotNull())
            .select(*by, "seq", (F.col("Timestamp") - F.col("prev_Timestamp")).cast("double").alias("gap_s")))


def object_reuse_gap(df: DataFrame, order, keys=()) -> DataFrame:
    """W5 (object trace): per block_id: requests since its previous access."""
    o = _seq(df, order, ("block_id",), keys)
    by = _names(*keys, "block_id")
    p = keyed_prev(o, by, ["seq"]).df
    return (p.filter(F.col("prev_seq").isNotNull())
            .select(*by, "seq", (F.col("seq") - F.col("prev_seq")).alias("gap")))


def _volume(o: Ordered, mode: str, keys, rank: bool) -> DataFrame:
    """Accesses with the summed same-op length strictly between them and the
    previous access of the block (same op), as a block count minus one. ``o``: the
    numbered trace."""
    keys = list(keys)
    o = prefix_sum(o, F.col("length").cast("long"), _names(*keys, "opcode"), out="cum")
    ex = _with(o, explode_blocks(o.df, mode).select(*_names(*keys, "opcode", "device_id", "block", "seq",
                                                            "length", "cum", BKT)))
    bkeys = _names(*keys, "opcode", "device_id", "block")
    p = keyed_prev(ex, bkeys, ["seq", "cum"], rank="access" if rank else None).df
    between = F.col("cum") - F.col("length").cast("long") - F.col("prev_cum")
    return p.withColumn("distance", idiv(between - BLOCK_SIZE, BLOCK_SIZE))


def _volume_cols(keys) -> list:
    return _names(*keys, "opcode", "device_id", "block", "seq", "distance")


def all_reuse_volume(df: DataFrame, order, mode: str = "floor", keys=()) -> DataFrame:
    """For every re-access of (op, device, block): floor((bytes of same-op
    requests strictly between - 4096) / 4096); an adjacent re-access gives -1.
    ``keys``: sums and previous accesses of each cell; ``seq`` is the place in the trace."""
    v = _volume(_seq(df, order, [*keys, *TRACE_COLS]), mode, keys, rank=False)
    return v.filter(F.col("prev_seq").isNotNull()).select(*_volume_cols(keys))


def first_reuse_volume(df: DataFrame, order, mode: str = "floor", keys=(), access: int = 2) -> DataFrame:
    """W6 (access=2): the volume distance at a block's first re-access only.
    W13 (access=3): at its second re-access."""
    v = _volume(_seq(df, order, [*keys, *TRACE_COLS]), mode, keys, rank=True)
    return v.filter(F.col("access") == access).select(*_volume_cols(keys))


def annotate_first_reuse(df: DataFrame, order, ops=("R", "W"), mode: str = "floor", keys=()) -> DataFrame:
    """The trace with blk_id, end_blk_id and first_rd (-1 unless a block of the
    request has its first re-access here; then the value of its highest such block).
    The trace is ordered and written once, for the distances and for the result."""
    keys = list(keys)
    o = _seq(df, order, [*keys, *TRACE_COLS])
    first = _volume(o, mode, keys, rank=True).filter((F.col("access") == 2) & F.col("opcode").isin(*ops))
    per_req = first.groupBy(*keys, "seq").agg(F.max_by("distance", "block").alias("__rd"))
    return (join_null_safe(o.df.drop(BKT), per_req, [*keys, "seq"], "left")
            .select(*_names(*keys, *TRACE_COLS, "seq"),
                    block_of_offset().alias("blk_id"), end_block().alias("end_blk_id"),
                    F.coalesce("__rd", F.lit(-1).cast("long")).alias("first_rd")))


def first_reuse_segments(df: DataFrame, order, keys=()) -> DataFrame:
    """Per op over the whole frame (``keys``: over each cell), first block of
    each request. At a block's first re-access emit the number of distinct blocks
    seen since the previous emission (emitting accesses are not recorded), then
    start a new segment."""
    keys = list(keys)
    o = _seq(df, order, TRACE_COLS, keys)
    by = _names(*keys, "opcode", "device_id", "block")
    ops = _names(*keys, "opcode")
    b = _with(o, o.df.withColumn("block", block_of_offset()).select(*by, "seq", BKT))
    r = keyed_prev(b, by, [], rank="access")
    r = _with(o, r.df.withColumn("isF", (F.col("access") == 2).cast("long")))
    s = prefix_sum(r, "isF", ops, out="cumF").df.withColumn("seg", F.col("cumF") - F.col("isF"))
    # distinct count per segment: Spark plans it as a two-phase aggregate keyed by
    # (opcode, seg, device, block) first, so a long segment is still split.
    d = (s.filter(F.col("isF") == 0).groupBy(*ops, "seg")
         .agg(F.countDistinct(F.struct("device_id", "block")).alias("distance")))
    e = s.filter(F.col("isF") == 1).select(*_names(*ops, "seg", "seq", "device_id", "block"))
    return (join_null_safe(e, d, [*ops, "seg"], "left")
            .select(*_names(*ops, "seq", "device_id", "block"),
                    F.coalesce("distance", F.lit(0).cast("long")).alias("distance")))


def inter_arrival(df: DataFrame, order, keys=("device_id",), ts: str = "timestamp",
                  extra=(), positions: bool = False) -> DataFrame:
    """Ts - previous ts in request order per key; the first row gets 0.
    ``order`` begins with ``ts``, so the rows are shuffled once by (key, stretch of
    time) and neither numbered nor written; ``positions`` adds ``seq``, for which
    the trace is ordered first."""
    keys = list(keys)
    t = df.select(*_names(*keys, ts, *extra, *order))
    if positions:
        p = keyed_prev(global_index(t, order), keys, [ts]).df.drop(BKT)
    else:
        p = lag_in_time(t, order, keys, ts, "prev_" + ts)
    return p.withColumn(
        "inter_arrival", F.coalesce(F.col(ts) - F.col("prev_" + ts), F.lit(0).cast("long"))
    ).drop("prev_" + ts)


def first_arrival_rank(df: DataFrame, order, mode: str = "cover", keys=()) -> DataFrame:
    """0-based id of every (device, block) in order of first appearance
    (request order, then block order inside a request); ``keys``: in each cell.
    The trace is ordered once: a request's fine bucket is an ordered range already, so first
    accesses are ranked inside the one they fall in, after those of earlier ones."""
    keys = list(keys)
    o = df if isinstance(df, Ordered) else number_in_cells(df.select(*_names(*keys, *TRACE_COLS, *order)), order, keys, fine=True)
    bucket = FB if FB in o.df.columns else BKT
    firsts = explode_blocks(o.df, mode).groupBy(*_names(*keys, "device_id", "block")).agg(
        F.min("seq").alias("first_seq"), F.min(bucket).alias(BKT))
    firsts = materialized(firsts)  # read for its counts and for its ranks
    n = len(o.before) if bucket == FB else o.nb
    return rank_in(Ordered(firsts, n, ()), ("first_seq", "block", "device_id"), keys, "rank").drop(BKT)


def reuse_stats(distances: DataFrame, keys=("opcode",), col: str = "distance") -> DataFrame:
    """Per op, count / mean / median / max / min of the distances."""
    keys = list(keys)
    # all statistics from one value -> count histogram (distinct distances grow
    # with the trace, so the median is never a per-group map of raw values)
    n = F.sum("cnt")
    stats = histogram_stats(
        distances, col, 0.5, keys, out="median_distance",
        extra=[n.alias("reuse_count"),
               # decimal: the sum of long distances passes a bigint on long traces
               (F.sum(F.col("__x").cast("decimal(19,0)") * F.col("cnt").cast("decimal(19,0)")).cast("double") / n)
               .alias("mean_distance"),
               F.max("__x").alias("max_distance"), F.min("__x").alias("min_distance")])
    return stats.select(*keys, "reuse_count", "mean_distance", "median_distance", "max_distance",
                        "min_distance")


def reuse_histogram(distances: DataFrame, col: str = "gap", bins: int = 50, keys=()) -> DataFrame:
    """Equal-width bins between min and max (last bin closed); empty bins kept.
    Bin index is exact integer arithmetic: least((x-min)*bins div (max-min), bins-1)."""
    keys = list(keys)
    distances = materialized(distances.select(*keys, col))  # read for its bounds and for its bins
    mm = distances.groupBy(*keys).agg(F.min(col).alias("mn"), F.max(col).alias("mx"))
    x = F.col(col)
    span = F.col("mx") - F.col("mn")
    b = F.when(span == 0, F.lit(0).cast("long")).otherwise(
        F.least(col_floordiv((x - F.col("mn")) * bins, span), F.lit(bins - 1)).cast("long"))
    counts = join_on_keys(distances, mm, keys).filter(x.isNotNull()).groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = mm.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    step = (F.col("mx") - F.col("mn")) / F.lit(float(bins))
    return (join_null_safe(grid, counts, [*keys, "bin"], "left")
            .select(*keys, "bin",
                    (F.col("mn") + F.col("bin") * step).alias("lo"),
                    F.when(F.col("bin") == bins - 1, F.col("mx").cast("double"))
                    .otherwise(F.col("mn") + (F.col("bin") + 1) * step).alias("hi"),
                    F.coalesce("n", F.lit(0).cast("long")).alias("n")))
