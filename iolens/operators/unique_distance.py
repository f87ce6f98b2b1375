"""Exact unique reuse distance.

For an access of a block by op o at request s whose previous same-op access was
at request p, the distance is the number of distinct (device, block) pairs that
o accesses in requests strictly between p and s.

The trace's order is cut into ranges of requests (the order's buckets), and each
(op, range) is counted by itself, in numpy:

* p in the range of s: the accesses a of the range before s with prev(a) <= p, less
  those up to p. (What is left are the first accesses after p of every block
  seen in between.)
* p in an earlier range q: the distinct blocks between p and s are
  - ``tail``: accesses of q after p whose next access is in s's range or later,
  - ``between``: accesses of the ranges between q and s's whose next access is there,
  - ``head``: accesses of s's range before s whose previous access is at p or earlier.
  Each block is counted at its last access before s's range, or else at its first in it.

``head`` and ``tail`` are counts of points below and left of a query, which
``count_below`` answers for a whole range at once. ``between`` depends on the two
ranges only: it is a running sum over the number of blocks by (range of an access,
range of the block's next access), at most half of ranges x ranges rows.

What ranges must know of each other is a carry: one row for each (op, block,
range), with the block's last request in an earlier range, its first in a later
one, and its accesses so far. It comes from an aggregate and a window by block
over ranges, so a hot block has one row a range. Ranges hold as many requests as
have ``RANGE_ROWS`` accesses in the mean, which is what a Python worker holds, or
the square root of all accesses if that is more: ranges x ranges stay below the accesses.
Where requests are longer than in the mean, a range of twice as many accesses or more is cut again.

An access is shuffled once to its range; a carry row to its block and to its range;
and only accesses whose previous one is in another range are shuffled again,
to meet their tail.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from iolens.functions.blocks import block_range, explode_blocks
from iolens.operators.reuse import TRACE_COLS
from iolens.plans.order import BKT, Ordered, join_null_safe, looked_up, materialized, number_in_cells, rows_per_bucket

#: accesses of a range; a worker takes about 700 bytes for each
RANGE_ROWS = 250_000


def count_below(rank: np.ndarray, upto: np.ndarray, below: np.ndarray) -> np.ndarray:
    """For each query, how many of the first ``upto`` entries of ``rank`` (each of
    0 .. n-1 once) are less than ``below`` (0 .. n): bit by bit, from the highest,
    entries are dealt by their bit, and a query follows its own bits with the
    interval of entries that agree with it so far."""
    left, right = np.zeros_like(upto), upto.copy()
    out = np.zeros(len(upto), np.int64)
    for bit in range(len(rank).bit_length() - 1, -1, -1):
        one = (rank >> bit & 1).astype(bool)
        zeros = np.concatenate(([0], np.cumsum(~one)))
        at_left, at_right = zeros[left], zeros[right]
        up = (below >> bit & 1).astype(bool)
        out += np.where(up, at_right - at_left, 0)
        left = np.where(up, zeros[-1] + left - at_left, at_left)
        right = np.where(up, zeros[-1] + right - at_right, at_right)
        rank = np.concatenate((rank[~one], rank[one]))
    return out


def _ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value's place in ascending order (every place once), and the sorted values."""
    order = np.argsort(values, kind="stable")
    rank = np.empty(len(values), np.int64)
    rank[order] = np.arange(len(values))
    return rank, values[order]


_FAR = np.iinfo(np.int64).max
_CARRY = ("last_seq", "last_range", "next_seq", "next_range", "before")


def _long(table: pa.Table, name: str, fill: int) -> np.ndarray:
    return table.column(name).fill_null(fill).to_numpy().astype(np.int64)


def range_distances(rows: pa.Table, first_only: bool = False) -> dict[str, np.ndarray]:
    """One (op, range): accesses (``seq``) and carry rows (``seq`` null). Returns
    ``row`` (an access of ``rows`` with the block), ``seq``, ``part``, ``prev_range``: a distance
    (``prev_range`` -1), or the head of an access whose previous one is in that
    range, or the tail of an access whose next one is at ``seq`` (``prev_range`` -2)."""
    block, device = _long(rows, "block", 0), _long(rows, "device_id", 0)
    no_device = rows.column("device_id").is_null().to_numpy()
    seq = _long(rows, "seq", -1)  # a block's carry row comes before its accesses
    order = np.lexsort((seq, block, device, no_device))
    new = np.ones(len(order), bool)
    new[1:] = np.any([x[order][1:] != x[order][:-1] for x in (block, device, no_device)], axis=0)
    of = np.cumsum(new) - 1
    carried = {c: np.full(of[-1] + 1 if len(of) else 0, -1, np.int64) for c in _CARRY}
    is_carry = seq[order] < 0
    for c in _CARRY:
        carried[c][of[is_carry]] = _long(rows, c, -1)[order][is_carry]

    order, of = order[~is_carry], of[~is_carry]
    s = seq[order]
    same = np.zeros(len(of), bool)
    same[1:] = of[1:] == of[:-1]
    last = np.append(~same[1:], True) if len(of) else same
    prev = np.where(same, np.concatenate(([-1], s[:-1]))[:len(s)], carried["last_seq"][of])
    start = np.maximum.accumulate(np.where(same, 0, np.arange(len(of)))) if len(of) else of
    rank_in_block = np.maximum(carried["before"][of], 0) + np.arange(len(of)) - start + 1
    next_range = np.where(last, carried["next_range"][of], -1)

    in_time = np.argsort(s, kind="stable")
    times = s[in_time]
    rank, prevs = _ranked(prev[in_time])
    ask = prev >= 0
    if first_only:
        ask &= rank_in_block == 2
    p = prev[ask]
    head = count_below(rank, np.searchsorted(times, s[ask], "left"), np.searchsorted(prevs, p, "right"))
    here = same[ask]
    head -= np.where(here, np.searchsorted(times, p, "right"), 0)
    found = [(order[ask], s[ask], head, np.where(here, -1, carried["last_range"][of][ask]))]

    # tails: accesses that are their block's last in this range
    out = last[in_time]
    leave = np.where(next_range[in_time][out] < 0, _FAR, next_range[in_time][out])
    at = times[out]
    rank, leaves = _ranked(leave)
    ask = last & (next_range >= 0)
    if first_only:
        ask &= rank_in_block == 1
    if ask.any():
        upto = np.searchsorted(at, s[ask], "right")
        low = np.searchsorted(leaves, next_range[ask], "left")
        every = np.full(len(upto), len(at))
        later = (len(at) - low) - (upto - count_below(rank, upto, low))
        assert len(every) == len(later)
        found.append((order[ask], carried["next_seq"][of][ask], later, np.full(len(upto), -2)))
    return dict(zip(("row", "seq", "part", "prev_range"), (np.concatenate(x) for x in zip(*found))))


def _carry(ex: DataFrame, by: list[str]) -> DataFrame:
    """A row for each (block, range): what ``_CARRY`` names, null where there is none."""
    mine = ex.groupBy(*by, BKT).agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by).orderBy(BKT)
    return mine.select(*by, BKT, F.lag("last").over(w).alias("last_seq"), F.lag(BKT).over(w).alias("last_range"),
                       F.lead("first").over(w).alias("next_seq"), F.lead(BKT).over(w).alias("next_range"),
                       (F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).alias("before"))


def _between(carry: DataFrame, by: list[str]) -> DataFrame:
    """``prev_range, range, between``: blocks whose last access before a range lies after an earlier range."""
    n = carry.groupBy(*by, F.col(BKT).alias("t"), F.col("next_range").alias("u")).agg(F.count(F.lit(1)).alias("n"))
    n = materialized(n)
    top = n.groupBy(*by).agg(F.max("t").alias("top"))
    ranges = join_null_safe(n.groupBy(*by, "t").agg(F.sum("n").alias("all")), top, by)
    # a row for each pair of ranges t < r: blocks that leave t for a range before r
    grid = ranges.filter("t < top").select(*by, "t", F.explode(F.sequence(F.col("t") + 1, F.col("top"))).alias("r"), "all")
    leave = n.filter(F.col("u").isNotNull()).withColumnRenamed("u", "r")
    each = join_null_safe(grid, leave, [*by, "t", "r"], "left")
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*by, "t").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stay = each.select(*by, "t", "r", (F.col("all") - before).alias("stay"), F.col("n").isNotNull().alias("asked"))
    later = F.sum("stay").over(Window.partitionBy(*by, "r").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, -1))
    return (stay.select(*by, F.col("t").alias("prev_range"), F.col("r").alias("range"), F.coalesce(later, F.lit(0)).alias("between"), "asked")
            .filter("asked").drop("asked"))


def _accesses(mode: str) -> Column:
    start, last = block_range(mode)
    return F.greatest(last - start + 1, F.lit(0).cast("long"))


def range_accesses(rows: int) -> int:
    """Accesses of a range of a trace with ``rows`` of them."""
    return max(RANGE_ROWS, math.isqrt(rows))


def range_requests(n: int, trace: DataFrame, mode: str) -> int:
    """Requests of a range of a trace of ``n``, by the mean number of blocks of a request."""
    rows = trace.agg(F.sum(_accesses(mode))).first()[0] or 0
    return max(1, range_accesses(rows) * n // max(1, rows))


def cut_bursts(o: Ordered, keys, mode: str) -> Ordered:
    """Ranges of requests with each that has twice the accesses it should, or more, cut
    at every so many of them: a range has less than twice as many and one request more."""
    held = {r[0]: r[1] or 0 for r in o.df.groupBy(BKT).agg(F.sum(_accesses(mode))).collect()}  # a number for each range
    most = range_accesses(sum(held.values()))
    parts = [max(1, held.get(b, 0) // most) for b in range(o.nb)]
    if max(parts) == 1:
        return o
    w = Window.partitionBy(BKT).orderBy(*keys, "seq").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(_accesses(mode)).over(w), F.lit(0))
    part = F.least(F.floor(before / F.lit(most)), looked_up(parts, F.col(BKT)) - 1)
    cut = o.df.withColumn("__part", part).withColumn(BKT, looked_up([*accumulate(parts, initial=0)], F.col(BKT)) + F.col("__part"))
    return Ordered(materialized(cut.drop("__part")), sum(parts), o.order, o.n)


def unique_reuse_distance(df: DataFrame, order, mode: str = "cover", first_only: bool = False, keys=()) -> DataFrame:
    """(opcode, device_id, block, seq, distance) for every re-access
    (``first_only``: only each block's first re-access). ``keys``: distances inside
    each cell, ``seq`` counts its requests."""
    keys = list(dict.fromkeys(keys))
    cells = list(dict.fromkeys([*keys, "opcode"]))
    by = list(dict.fromkeys([*cells, "device_id", "block"]))
    trace = df.select(*dict.fromkeys([*keys, *TRACE_COLS, *order]))
    o = number_in_cells(trace, order, keys, rpb=lambda n, placed: min(rows_per_bucket(df), range_requests(n, placed, mode)))
    o = cut_bursts(o, keys, mode)  # also a single range: requests that agree in the whole order key are never dealt to several
    ex = explode_blocks(o.df, mode).select(*by, "seq", BKT)
    rows = ex.select("*", *[F.lit(None).cast("long").alias(c) for c in _CARRY])
    if o.nb > 1:
        carry = materialized(_carry(ex, by))
        rows = rows.unionByName(carry.filter("last_seq is not null or next_seq is not null").withColumn("seq", F.lit(None).cast("long")))

    fields = [f for f in ex.schema if f.name in by]
    schema = T.StructType([*fields, T.StructField("seq", T.LongType()), T.StructField("part", T.LongType()),
                           T.StructField("prev_range", T.LongType()), T.StructField("range", T.LongType())])

    def run(table: pa.Table) -> pa.Table:
        got = range_distances(table, first_only)
        at = pa.array(got["row"])
        here = table.column(BKT)[0].as_py()
        return pa.table([*(table.column(f.name).take(at) for f in fields), pa.array(got["seq"]), pa.array(got["part"]),
                         pa.array(got["prev_range"]), pa.array(np.full(len(at), here, np.int64))], names=[f.name for f in schema])

    found = rows.groupBy(*cells, BKT).applyInArrow(run, schema)
    if o.nb == 1:
        return found.select(*by, "seq", F.col("part").alias("distance"))
    found = materialized(found)
    done = found.filter("prev_range = -1").select(*by, "seq", F.col("part").alias("distance"))
    # a head and a tail meet at the access; -2 marks the tail, so the head's range is the larger
    met = (found.filter("prev_range <> -1").groupBy(*by, "seq")
           .agg(F.sum("part").alias("part"), F.max("prev_range").alias("prev_range"), F.max_by("range", "prev_range").alias("range")))
    cross = join_null_safe(met, _between(carry, cells), [*cells, "prev_range", "range"])
    return done.unionByName(cross.select(*by, "seq", (F.col("part") + F.col("between")).alias("distance")))
