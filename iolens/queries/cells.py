"""Forms of the order-dependent operators that the plain queries don't reach:
traces with null timestamps and opcodes, many order buckets, and one run per
(slice, device) cell, in which positions and segments restart.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from iolens.operators import access, cdf, features, rates, report, reuse, sizes
from iolens.operators.unique_distance import unique_reuse_distance
from iolens.plans.order import CONF_ROWS_PER_BUCKET
from iolens.queries import register
from iolens.queries.aggregates import A15_SQL, _round_std
from iolens.queries.sources import GRID_BASE, GRID_SQL
from iolens.queries.sqlparts import SEQ_NULLS, SEQ_TRACE, exploded, volume
from iolens.queries.windows import TO, W2_SQL, W11_SQL, W12_SQL, _w12_cells, _w12_select
from iolens.sources import readers as R
from iolens.sources import views as V
from iolens.sources.views import with_views

BUCKETS = 7


@contextmanager
def small_buckets(spark, sf):
    """Buckets are cut while a query is built; only these are small, about ``BUCKETS`` to the event trace."""
    rows = max(100, V.trace(spark, sf).count() // BUCKETS)
    old = spark.conf.get(CONF_ROWS_PER_BUCKET, None)
    spark.conf.set(CONF_ROWS_PER_BUCKET, str(min(rows, int(old)) if old else rows))
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(CONF_ROWS_PER_BUCKET)
        else:
            spark.conf.set(CONF_ROWS_PER_BUCKET, old)


def _bucketed(name: str, sql: str):
    """Register a query that is built with small buckets."""
    def deco(fn):
        def run(spark, sf):
            with small_buckets(spark, sf):
                return fn(spark, sf)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        return register(name, sql)(run)
    return deco


# ------------------------------------------------------------ nulls, any size
def _null_trace(spark, sf):
    t = V.trace(spark, sf)
    r = F.col("tie") % 97
    return (t.withColumn("opcode", F.when(r != 7, F.col("opcode")))
            .withColumn("timestamp", F.when(r != 5, F.col("timestamp"))))


_W1_NULLS = with_views(SEQ_NULLS + "\nSELECT * FROM r", "trace")
_W7_NULLS = with_views(volume("floor", seq=SEQ_NULLS) + """
SELECT opcode, device_id, block, seq, distance FROM v WHERE ps IS NOT NULL""", "trace")
_W10_NULLS = with_views(SEQ_NULLS + """
SELECT device_id, "timestamp", seq,
       coalesce("timestamp" - lag("timestamp") OVER (PARTITION BY device_id ORDER BY seq), 0) AS inter_arrival
FROM r""", "trace")


@register("request_sequence_nulls", _W1_NULLS)
def q_request_sequence_nulls(spark, sf):
    return reuse.request_sequence(_null_trace(spark, sf), TO)


@_bucketed("request_sequence_nulls_bucketed", _W1_NULLS)
def q_request_sequence_nulls_bucketed(spark, sf):
    return reuse.request_sequence(_null_trace(spark, sf), TO)


@register("all_reuse_volume_nulls", _W7_NULLS)
def q_all_reuse_volume_nulls(spark, sf):
    return reuse.all_reuse_volume(_null_trace(spark, sf), TO)


@_bucketed("all_reuse_volume_nulls_bucketed", _W7_NULLS)
def q_all_reuse_volume_nulls_bucketed(spark, sf):
    return reuse.all_reuse_volume(_null_trace(spark, sf), TO)


@_bucketed("inter_arrival_nulls_bucketed", _W10_NULLS)
def q_inter_arrival_nulls_bucketed(spark, sf):
    return reuse.inter_arrival(_null_trace(spark, sf), TO, positions=True).select("device_id", "timestamp", "seq", "inter_arrival")


@_bucketed("inter_arrival_in_time_nulls_bucketed", with_views(SEQ_NULLS + """
SELECT device_id, "timestamp", tie,
       coalesce("timestamp" - lag("timestamp") OVER (PARTITION BY device_id ORDER BY seq), 0) AS inter_arrival
FROM r""", "trace"))
def q_inter_arrival_in_time_nulls_bucketed(spark, sf):
    return reuse.inter_arrival(_null_trace(spark, sf), TO).select("device_id", "timestamp", "tie", "inter_arrival")


# --------------------------------------------------------- many order buckets
@_bucketed("request_sequence_bucketed", with_views(SEQ_TRACE + "\nSELECT * FROM r", "trace"))
def q_request_sequence_bucketed(spark, sf):
    return reuse.request_sequence(V.trace(spark, sf), TO)


@_bucketed("reuse_gap_requests_bucketed", with_views(W2_SQL + "\nSELECT * FROM w2", "trace"))
def q_reuse_gap_requests_bucketed(spark, sf):
    return reuse.reuse_gap_requests(V.trace(spark, sf), TO, "count")


@_bucketed("all_reuse_volume_bucketed", with_views(volume("floor") + """
SELECT opcode, device_id, block, seq, distance FROM v WHERE ps IS NOT NULL""", "trace"))
def q_all_reuse_volume_bucketed(spark, sf):
    return reuse.all_reuse_volume(V.trace(spark, sf), TO)


def _segments_sql(seq: str, cell: str = "") -> str:
    """W9 by plain windows; ``cell``: leading columns of a cell, each with a comma."""
    return seq + f"""
, a AS (SELECT {cell} opcode, device_id, "offset" // 4096 AS block, seq,
               row_number() OVER (PARTITION BY {cell} opcode, device_id, "offset" // 4096 ORDER BY seq) AS acc FROM r),
  sg AS (SELECT *, CAST(acc = 2 AS INTEGER) AS isf,
               sum(CAST(acc = 2 AS INTEGER)) OVER (PARTITION BY {cell} opcode ORDER BY seq ROWS UNBOUNDED PRECEDING)
               - CAST(acc = 2 AS INTEGER) AS seg FROM a),
  d AS (SELECT {cell} opcode, seg, count(*) AS distance
        FROM (SELECT DISTINCT {cell} opcode, seg, device_id, block FROM sg WHERE isf = 0) GROUP BY ALL),
  w9 AS (SELECT sg.*, coalesce(d.distance, 0) AS distance FROM sg LEFT JOIN d USING ({cell} opcode, seg) WHERE sg.isf = 1)"""


@_bucketed("first_reuse_segments_bucketed", with_views(_segments_sql(SEQ_TRACE) + """
SELECT opcode, seq, device_id, block, distance FROM w9""", "trace"))
def q_first_reuse_segments_bucketed(spark, sf):
    return reuse.first_reuse_segments(V.trace(spark, sf), TO)


@_bucketed("first_arrival_rank_bucketed", with_views(W11_SQL + "\nSELECT * FROM w11", "trace"))
def q_first_arrival_rank_bucketed(spark, sf):
    return reuse.first_arrival_rank(V.trace(spark, sf), TO)


@_bucketed("unique_reuse_distance_bucketed", with_views(W12_SQL + _w12_select("p IS NOT NULL"), "trace"))
def q_unique_reuse_distance_bucketed(spark, sf):
    return unique_reuse_distance(V.trace(spark, sf), TO)


@_bucketed("device_features_bucketed", with_views(A15_SQL + """
SELECT * REPLACE (round(io_size_std, 6) AS io_size_std, round(response_time_std, 3) AS response_time_std)
FROM a15""", "trace"))
def q_device_features_bucketed(spark, sf):
    return _round_std(features.device_features(V.trace(spark, sf), TO))


@_bucketed("reuse_cdf_index_bucketed", with_views(W2_SQL + """
, s AS (SELECT gap, row_number() OVER (ORDER BY gap) - 1 AS i, count(*) OVER () AS n FROM w2)
SELECT gap, count(*) AS cnt, min(i) / any_value(n) AS cdf_first, max(i) / any_value(n) AS cdf_last
FROM s GROUP BY 1""", "trace"))
def q_reuse_cdf_index_bucketed(spark, sf):
    return cdf.index_cdf(reuse.reuse_gap_requests(V.trace(spark, sf), TO, "count"), "gap", out="gap")


# ------------------------------------------------- CDFs of the first-reuse frames
def _kblocks_sql(frame: str) -> str:
    return f"""
, k AS (SELECT opcode, distance / CAST(1000 AS DOUBLE) AS kblocks,
               row_number() OVER (PARTITION BY opcode ORDER BY distance) - 1 AS i,
               count(*) OVER (PARTITION BY opcode) AS n FROM {frame}),
  h AS (SELECT opcode, kblocks, count(*) AS cnt, min(i) AS fi, max(i) AS li, any_value(n) AS n FROM k GROUP BY 1, 2)
SELECT opcode, kblocks, cnt,
  CASE WHEN n = 1 THEN CAST(0 AS DOUBLE) WHEN fi = n - 1 THEN CAST(1 AS DOUBLE) ELSE fi * (CAST(1 AS DOUBLE) / (n - 1)) END AS pct_first,
  CASE WHEN n = 1 THEN CAST(0 AS DOUBLE) WHEN li = n - 1 THEN CAST(1 AS DOUBLE) ELSE li * (CAST(1 AS DOUBLE) / (n - 1)) END AS pct_last
FROM h"""


def _kblocks(frame):
    return cdf.percent_cdf(frame.withColumn("kb", F.col("distance") / F.lit(1000.0)), "kb", ["opcode"], out="kblocks", stop=1.0)


@register("first_reuse_cdf_kblocks", with_views(volume("floor") + _kblocks_sql("(SELECT * FROM v WHERE acc = 2)"), "trace"))
def q_first_reuse_cdf_kblocks(spark, sf):
    """C4 over W6."""
    return _kblocks(reuse.first_reuse_volume(V.trace(spark, sf), TO))


@register("first_reuse_segments_cdf_kblocks", with_views(_segments_sql(SEQ_TRACE) + _kblocks_sql("w9"), "trace"))
def q_first_reuse_segments_cdf_kblocks(spark, sf):
    """C4 over W9."""
    return _kblocks(reuse.first_reuse_segments(V.trace(spark, sf), TO))


# ------------------------------------------------------- one run per cell
CELL = ["slice_start", "device_id"]
SEQ_CELL = GRID_SQL + """,
  r AS (SELECT *, row_number() OVER (PARTITION BY slice_start, device_id ORDER BY "timestamp", tie) - 1 AS seq FROM g)"""


def _cells(spark, sf):
    return R.load_device_grid(V.trace(spark, sf), range(8), n_hours=720, base=GRID_BASE)


@register("reuse_gap_by_op_per_slice", with_views(SEQ_CELL + """
, l AS (SELECT slice_start, opcode, device_id, "offset" // 4096 AS block, seq,
               lag(seq) OVER (PARTITION BY slice_start, opcode, device_id, "offset" // 4096 ORDER BY seq) AS p FROM r)
SELECT slice_start, device_id, opcode, block, seq, seq - p AS gap FROM l WHERE p IS NOT NULL""", "trace"))
def q_reuse_gap_by_op_per_slice(spark, sf):
    return reuse.reuse_gap_by_op(_cells(spark, sf), TO, keys=CELL)


@register("reuse_gap_requests_per_slice", with_views(SEQ_CELL + f"""
, e AS ({exploded('r', 'count', 'slice_start, device_id, seq')}),
  l AS (SELECT *, lag(seq) OVER (PARTITION BY slice_start, device_id, block ORDER BY seq) AS p FROM e)
SELECT slice_start, device_id, block, seq, seq - p AS gap FROM l WHERE p IS NOT NULL""", "trace"))
def q_reuse_gap_requests_per_slice(spark, sf):
    return reuse.reuse_gap_requests(_cells(spark, sf), TO, "count", keys=CELL)


@register("first_reuse_segments_per_slice", with_views(_segments_sql(
    SEQ_CELL.replace("SELECT *, row_number", "SELECT *, device_id AS dev, row_number"), "slice_start, dev,") + """
SELECT slice_start, opcode, seq, device_id, block, distance FROM w9""", "trace"))
def q_first_reuse_segments_per_slice(spark, sf):
    return reuse.first_reuse_segments(_cells(spark, sf), TO, keys=CELL)


@register("first_arrival_rank_per_slice", with_views(SEQ_CELL + f"""
, e AS ({exploded('r', 'cover', 'slice_start, device_id, seq')}),
  f AS (SELECT slice_start, device_id, block, min(seq) AS first_seq FROM e GROUP BY 1, 2, 3)
SELECT slice_start, device_id, block, first_seq,
       row_number() OVER (PARTITION BY slice_start, device_id ORDER BY first_seq, block) - 1 AS rank FROM f""", "trace"))
def q_first_arrival_rank_per_slice(spark, sf):
    return reuse.first_arrival_rank(_cells(spark, sf), TO, keys=CELL)


@register("size_cdf_sampled_per_slice", with_views(GRID_SQL + """
, cs AS (SELECT slice_start, device_id, opcode, "length",
               row_number() OVER (PARTITION BY slice_start, device_id, opcode ORDER BY "length") - 1 AS i,
               count(*) OVER (PARTITION BY slice_start, device_id, opcode) AS n FROM g)
SELECT slice_start, device_id, opcode, CAST(i AS INTEGER) AS point, "length", (i + 1) / n AS cdf FROM cs""", "trace"))
def q_size_cdf_sampled_per_slice(spark, sf):
    """C1 per cell; no cell of these tables reaches 1000 requests, so all ranks are kept."""
    return sizes.size_cdf_sampled(_cells(spark, sf), keys=CELL)


@register("iops_mean_peak_per_slice", with_views(GRID_SQL + """
, cs AS (SELECT slice_start, device_id, "timestamp" - "timestamp" % 1000000 AS sec, count(*) AS n FROM g GROUP BY 1, 2, 3),
  a AS (SELECT slice_start, device_id, min(sec) AS f, max(sec) AS l, min(sec) - min(sec) % 86400000000 AS d0
        FROM cs GROUP BY 1, 2),
  agg AS (SELECT cs.slice_start, cs.device_id, cs.sec - (cs.sec - a.d0) % 60000000 AS bin_start, sum(n) / count(*) AS mean_iops,
                 max(n) AS peak_iops FROM cs JOIN a USING (slice_start, device_id) GROUP BY 1, 2, 3),
  b AS (SELECT slice_start, device_id,
               unnest(generate_series(f - (f - d0) % 60000000, l - (l - d0) % 60000000, 60000000)) AS bin_start FROM a)
SELECT b.slice_start, b.device_id, b.bin_start, agg.mean_iops, agg.peak_iops
FROM b LEFT JOIN agg USING (slice_start, device_id, bin_start)""", "trace"))
def q_iops_mean_peak_per_slice(spark, sf):
    return rates.iops_mean_peak(_cells(spark, sf), 60, keys=CELL)


@register("access_space_per_slice", with_views(GRID_SQL + f"""
SELECT slice_start, "timestamp", device_id, block
FROM ({exploded('g', 'cover', 'slice_start, device_id, "timestamp"')})""", "trace"))
def q_access_space_per_slice(spark, sf):
    """X1/X3 per cell."""
    return access.access_space(_cells(spark, sf), keys=CELL)


@register("access_raw_offset_per_slice", with_views(GRID_SQL + """
SELECT slice_start, device_id, "timestamp" AS time_s, "offset" FROM g""", "trace"))
def q_access_raw_offset_per_slice(spark, sf):
    """X4 per cell, in the canonical trace's units."""
    return access.access_raw_offset(_cells(spark, sf).withColumnsRenamed({"timestamp": "Timestamp", "offset": "Offset"}), keys=CELL)


@register("unique_reuse_distance_per_slice", with_views(_w12_cells("slice_start, device_id", "p IS NOT NULL", SEQ_CELL), "trace"))
def q_unique_reuse_distance_per_slice(spark, sf):
    return unique_reuse_distance(_cells(spark, sf), TO, keys=CELL)


@_bucketed("unique_reuse_distance_per_slice_bucketed", with_views(_w12_cells("slice_start, device_id", "acc = 2", SEQ_CELL), "trace"))
def q_unique_reuse_distance_per_slice_bucketed(spark, sf):
    return unique_reuse_distance(_cells(spark, sf), TO, first_only=True, keys=CELL)


@_bucketed("access_arrival_bucketed", with_views(W11_SQL + """
SELECT e."timestamp", e.device_id, e.block, w11.rank FROM e JOIN w11 USING (device_id, block)""", "trace"))
def q_access_arrival_bucketed(spark, sf):
    t = V.trace(spark, sf)
    return access.access_arrival(t, reuse.first_arrival_rank(t, TO))


# --------------------------------------------- S8: six analyses of every cell in one run
def _ends(frame: str, x: str, name: str) -> str:
    """C4's last position by (cell, op, value)."""
    return f"""
SELECT slice_start, device_id, '{name}' AS analysis, opcode, CAST({x} AS DOUBLE) AS x,
       CASE WHEN n = 1 THEN CAST(0 AS DOUBLE) WHEN max(i) = n - 1 THEN CAST(1 AS DOUBLE) ELSE max(i) * (CAST(1 AS DOUBLE) / (n - 1)) END AS y
FROM (SELECT *, row_number() OVER (PARTITION BY slice_start, device_id, opcode ORDER BY {x}) - 1 AS i,
             count(*) OVER (PARTITION BY slice_start, device_id, opcode) AS n FROM {frame}) GROUP BY slice_start, device_id, opcode, {x}, n"""


@register("cell_report", with_views(_segments_sql(
    SEQ_CELL.replace("SELECT *, row_number", "SELECT *, device_id AS dev, row_number"), "slice_start, dev,") + f"""
, lg AS (SELECT slice_start, opcode, device_id, seq, lag(seq) OVER (PARTITION BY slice_start, opcode, device_id, "offset" // 4096 ORDER BY seq) AS p FROM r),
  gp AS (SELECT slice_start, device_id, opcode, seq - p AS gap FROM lg WHERE p IS NOT NULL),
  cs AS (SELECT slice_start, device_id, opcode, "length", row_number() OVER (PARTITION BY slice_start, device_id, opcode ORDER BY "length") - 1 AS i,
               count(*) OVER (PARTITION BY slice_start, device_id, opcode) AS n FROM g),
  sc AS (SELECT slice_start, device_id, "timestamp" - "timestamp" % 1000000 AS sec, count(*) AS n FROM g GROUP BY 1, 2, 3),
  f0 AS (SELECT slice_start, device_id, min(sec) AS f, max(sec) AS l, min(sec) - min(sec) % 86400000000 AS d0 FROM sc GROUP BY 1, 2),
  ag AS (SELECT sc.slice_start, sc.device_id, sc.sec - (sc.sec - f0.d0) % 10000000 AS bin_start, sum(n) / count(*) AS mean_iops
         FROM sc JOIN f0 USING (slice_start, device_id) GROUP BY 1, 2, 3),
  bn AS (SELECT slice_start, device_id, unnest(generate_series(f - (f - d0) % 10000000, l - (l - d0) % 10000000, 10000000)) AS bin_start FROM f0),
  ex AS ({exploded('r', 'cover', 'slice_start, device_id, seq, "timestamp"')}),
  fa AS (SELECT slice_start, device_id, block, min(seq) AS first_seq FROM ex GROUP BY 1, 2, 3),
  rk AS (SELECT *, row_number() OVER (PARTITION BY slice_start, device_id ORDER BY first_seq, block) - 1 AS rank FROM fa)
SELECT slice_start, device_id, 'size_cdf' AS analysis, opcode, CAST("length" AS DOUBLE) AS x, (i + 1) / n AS y FROM cs
UNION ALL SELECT bn.slice_start, bn.device_id, 'request_rate', NULL, CAST(bin_start AS DOUBLE), ag.mean_iops FROM bn LEFT JOIN ag USING (slice_start, device_id, bin_start)
UNION ALL {_ends('gp', 'gap', 'reuse_cdf')}
UNION ALL {_ends('w9', 'distance', 'unique_reuse_cdf')}
UNION ALL SELECT ex.slice_start, ex.device_id, 'arrival', NULL, CAST(ex."timestamp" AS DOUBLE), CAST(rk.rank AS DOUBLE) FROM ex JOIN rk USING (slice_start, device_id, block)
UNION ALL SELECT slice_start, device_id, 'space', NULL, CAST("timestamp" AS DOUBLE), CAST(block AS DOUBLE) FROM ex""", "trace"))
def q_cell_report(spark, sf):
    """The points of every cell's six charts, from one ordering of the grid."""
    t = report.cell_report(_cells(spark, sf), TO, CELL)
    xy = {"size_cdf": ("opcode", "length", "cdf"), "request_rate": (None, "bin_start", "mean_iops"), "reuse_cdf": ("opcode", "gap", "pct_last"),
          "unique_reuse_cdf": ("opcode", "distance", "pct_last"), "arrival": (None, "timestamp", "rank"), "space": (None, "timestamp", "block")}
    out = None
    for name, (op, x, y) in xy.items():
        rows = t[name].select(*CELL, F.lit(name).alias("analysis"), (F.col(op) if op else F.lit(None).cast("string")).alias("opcode"),
                              F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
        out = rows if out is None else out.unionByName(rows)
    return out
