"""The analyses of every (slice, device) cell in one run.

The grid of cells is ordered, numbered and written once; all six tables read
that. Cells without requests have no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from iolens.operators import access, cdf, rates, reuse, sizes
from iolens.plans.order import BKT

CELL = ("slice_start", "device_id")
ANALYSES = ("size_cdf", "request_rate", "reuse_cdf", "unique_reuse_cdf", "arrival", "space")


def cell_report(grid: DataFrame, order, keys=CELL, interval_s: int = 10) -> dict[str, DataFrame]:
    """By name: request sizes (C1), request rate by interval (A5), distribution of
    same-op reuse gaps (W3, C4 form) and of distinct blocks between first reuses (W9),
    accesses by arrival rank (X2) and by block (X1)."""
    keys = list(keys)
    o = reuse.ordered(grid.select(*dict.fromkeys([*keys, *reuse.TRACE_COLS, *order])), order, keys)
    cells = o.df.drop(BKT)
    by_op = [*keys, "opcode"]
    ranks = reuse.first_arrival_rank(o, order, keys=keys)
    return dict(zip(ANALYSES, (
        sizes.size_cdf_sampled(cells, keys=keys),
        rates.iops_mean_peak(cells, interval_s, keys=keys),
        cdf.percent_cdf(reuse.reuse_gap_by_op(o, order, keys=keys), "gap", by_op, out="gap", stop=1.0),
        cdf.percent_cdf(reuse.first_reuse_segments(o, order, keys=keys), "distance", by_op, out="distance", stop=1.0),
        access.access_arrival(cells, ranks, keys=keys),
        access.access_space(cells, keys=keys))))
