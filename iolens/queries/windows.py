"""Order-dependent queries (W*, A18, A19, C3-C5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from iolens.operators import cdf, reuse
from iolens.queries import register
from iolens.queries.sqlparts import SEQ_TRACE, exploded, volume
from iolens.sources import views as V
from iolens.sources.views import with_views

TO = V.TRACE_ORDER


@register("request_sequence", with_views(SEQ_TRACE + "\nSELECT * FROM r", "trace"))
def q_request_sequence(spark, sf):
    return reuse.request_sequence(V.trace(spark, sf), TO)


W2_SQL = SEQ_TRACE + f"""
, e AS ({exploded('r', 'count', 'device_id, seq')}),
  l AS (SELECT device_id, block, seq, lag(seq) OVER (PARTITION BY device_id, block ORDER BY seq) AS p FROM e),
  w2 AS (SELECT device_id, block, seq, seq - p AS gap FROM l WHERE p IS NOT NULL)"""


@register("reuse_gap_requests", with_views(W2_SQL + "\nSELECT * FROM w2", "trace"))
def q_reuse_gap_requests(spark, sf):
    return reuse.reuse_gap_requests(V.trace(spark, sf), TO, "count")


@register("reuse_gap_by_op", with_views(SEQ_TRACE + """
, l AS (SELECT opcode, device_id, "offset" // 4096 AS block, seq,
               lag(seq) OVER (PARTITION BY opcode, device_id, "offset" // 4096 ORDER BY seq) AS p FROM r)
SELECT opcode, device_id, block, seq, seq - p AS gap FROM l WHERE p IS NOT NULL""", "trace"))
def q_reuse_gap_by_op(spark, sf):
    return reuse.reuse_gap_by_op(V.trace(spark, sf), TO)


@register("reuse_gap_seconds", with_views("""
, r AS (SELECT *, row_number() OVER (ORDER BY "Timestamp", tie) - 1 AS seq FROM sector_trace),
  l AS (SELECT "VolumeID", "Offset" // 512 AS block, seq, "Timestamp",
               lag("Timestamp") OVER (PARTITION BY "VolumeID", "Offset" // 512 ORDER BY seq) AS p FROM r)
SELECT "VolumeID", block, seq, CAST("Timestamp" - p AS DOUBLE) AS gap_s FROM l WHERE p IS NOT NULL""",
    "sector_trace"))
def q_reuse_gap_seconds(spark, sf):
    return reuse.reuse_gap_seconds(V.sector_trace(spark, sf), V.SECTOR_ORDER)


W5_SQL = """
, r AS (SELECT block_id, row_number() OVER (ORDER BY "time", event_id) - 1 AS seq FROM object_trace),
  l AS (SELECT block_id, seq, lag(seq) OVER (PARTITION BY block_id ORDER BY seq) AS p FROM r),
  w5 AS (SELECT block_id, seq, seq - p AS gap FROM l WHERE p IS NOT NULL)"""


@register("object_reuse_gap", with_views(W5_SQL + "\nSELECT * FROM w5", "object_trace"))
def q_object_reuse_gap(spark, sf):
    return reuse.object_reuse_gap(V.object_trace(spark, sf), V.OBJECT_ORDER)


@register("first_reuse_volume", with_views(volume("floor") + """
SELECT opcode, device_id, block, seq, distance FROM v WHERE acc = 2""", "trace"))
def q_first_reuse_volume(spark, sf):
    return reuse.first_reuse_volume(V.trace(spark, sf), TO)


@register("all_reuse_volume", with_views(volume("floor") + """
SELECT opcode, device_id, block, seq, distance FROM v WHERE ps IS NOT NULL""", "trace"))
def q_all_reuse_volume(spark, sf):
    return reuse.all_reuse_volume(V.trace(spark, sf), TO)


@register("second_reuse_volume", with_views(volume("floor") + """
SELECT opcode, device_id, block, seq, distance FROM v WHERE acc = 3""", "trace"))
def q_second_reuse_volume(spark, sf):
    return reuse.first_reuse_volume(V.trace(spark, sf), TO, access=3)


@register("annotate_first_reuse", with_views(volume("floor") + """
, f AS (SELECT seq, arg_max(distance, block) AS rd FROM v WHERE acc = 2 GROUP BY seq)
SELECT device_id, opcode, "offset", "length", "timestamp", seq, "offset" // 4096 AS blk_id,
       ("offset" + "length") // 4096 AS end_blk_id, coalesce(f.rd, -1) AS first_rd
FROM r LEFT JOIN f USING (seq)""", "trace"))
def q_annotate_first_reuse(spark, sf):
    return reuse.annotate_first_reuse(V.trace(spark, sf), TO)


@register("first_reuse_segments", with_views(SEQ_TRACE + """
, a AS (SELECT opcode, device_id, "offset" // 4096 AS block, seq,
               row_number() OVER (PARTITION BY opcode, device_id, "offset" // 4096 ORDER BY seq) AS acc FROM r),
  s AS (SELECT *, CAST(acc = 2 AS INTEGER) AS isf,
               sum(CAST(acc = 2 AS INTEGER)) OVER (PARTITION BY opcode ORDER BY seq ROWS UNBOUNDED PRECEDING)
               - CAST(acc = 2 AS INTEGER) AS seg FROM a),
  d AS (SELECT opcode, seg, count(*) AS distance
        FROM (SELECT DISTINCT opcode, seg, device_id, block FROM s WHERE isf = 0) GROUP BY 1, 2)
SELECT s.opcode, s.seq, s.device_id, s.block, coalesce(d.distance, 0) AS distance
FROM s LEFT JOIN d USING (opcode, seg) WHERE s.isf = 1""", "trace"))
def q_first_reuse_segments(spark, sf):
    return reuse.first_reuse_segments(V.trace(spark, sf), TO)


@register("inter_arrival", with_views(SEQ_TRACE + """
SELECT device_id, "timestamp", seq,
       coalesce("timestamp" - lag("timestamp") OVER (PARTITION BY device_id ORDER BY seq), 0) AS inter_arrival
FROM r""", "trace"))
def q_inter_arrival(spark, sf):
    return reuse.inter_arrival(V.trace(spark, sf), TO, positions=True).select("device_id", "timestamp", "seq", "inter_arrival")


W10_SQL = SEQ_TRACE + """
SELECT device_id, "timestamp", tie,
       coalesce("timestamp" - lag("timestamp") OVER (PARTITION BY device_id ORDER BY seq), 0) AS inter_arrival
FROM r"""


@register("inter_arrival_in_time", with_views(W10_SQL, "trace"))
def q_inter_arrival_in_time(spark, sf):
    """W10 without positions: the trace is neither numbered nor written."""
    return reuse.inter_arrival(V.trace(spark, sf), TO).select("device_id", "timestamp", "tie", "inter_arrival")


W11_SQL = SEQ_TRACE + f"""
, e AS ({exploded('r', 'cover', 'device_id, seq, "timestamp"')}),
  f AS (SELECT device_id, block, min(seq) AS first_seq FROM e GROUP BY 1, 2),
  w11 AS (SELECT device_id, block, first_seq, row_number() OVER (ORDER BY first_seq, block) - 1 AS rank FROM f)"""


@register("first_arrival_rank", with_views(W11_SQL + "\nSELECT * FROM w11", "trace"))
def q_first_arrival_rank(spark, sf):
    return reuse.first_arrival_rank(V.trace(spark, sf), TO)


@register("reuse_stats", with_views(volume("floor") + """
SELECT opcode, count(distance) AS reuse_count, sum(distance) / count(distance) AS mean_distance,
       quantile_cont(distance, 0.5) AS median_distance, max(distance) AS max_distance,
       min(distance) AS min_distance
FROM v WHERE ps IS NOT NULL GROUP BY 1""", "trace"))
def q_reuse_stats(spark, sf):
    return reuse.reuse_stats(reuse.all_reuse_volume(V.trace(spark, sf), TO))


@register("reuse_histogram", with_views(W5_SQL + """
, mm AS (SELECT min(gap) AS mn, max(gap) AS mx FROM w5),
  c AS (SELECT CASE WHEN mx = mn THEN 0 ELSE least(((gap - mn) * 50) // (mx - mn), 49) END AS bin,
               count(*) AS n FROM w5 CROSS JOIN mm GROUP BY 1),
  g AS (SELECT unnest(generate_series(0, 49)) AS bin)
SELECT g.bin, mn + g.bin * ((mx - mn) / CAST(50 AS DOUBLE)) AS lo,
       CASE WHEN g.bin = 49 THEN CAST(mx AS DOUBLE) ELSE mn + (g.bin + 1) * ((mx - mn) / CAST(50 AS DOUBLE)) END AS hi,
       coalesce(c.n, 0) AS n
FROM g CROSS JOIN mm LEFT JOIN c ON c.bin = g.bin""", "object_trace"))
def q_reuse_histogram(spark, sf):
    return reuse.reuse_histogram(reuse.object_reuse_gap(V.object_trace(spark, sf), V.OBJECT_ORDER), "gap")


@register("reuse_cdf_index", with_views(W2_SQL + """
, s AS (SELECT gap, row_number() OVER (ORDER BY gap) - 1 AS i, count(*) OVER () AS n FROM w2)
SELECT gap, count(*) AS cnt, min(i) / any_value(n) AS cdf_first, max(i) / any_value(n) AS cdf_last
FROM s GROUP BY 1""", "trace"))
def q_reuse_cdf_index(spark, sf):
    return cdf.index_cdf(reuse.reuse_gap_requests(V.trace(spark, sf), TO, "count"), "gap", out="gap")


@register("reuse_cdf_kblocks", with_views(volume("floor") + """
, s AS (SELECT opcode, distance / CAST(1000 AS DOUBLE) AS kblocks,
               row_number() OVER (PARTITION BY opcode ORDER BY distance) - 1 AS i,
               count(*) OVER (PARTITION BY opcode) AS n FROM v WHERE ps IS NOT NULL),
  g AS (SELECT opcode, kblocks, count(*) AS cnt, min(i) AS fi, max(i) AS li, any_value(n) AS n FROM s GROUP BY 1, 2)
SELECT opcode, kblocks, cnt,
  CASE WHEN n = 1 THEN CAST(0 AS DOUBLE) WHEN fi = n - 1 THEN CAST(1 AS DOUBLE) ELSE fi * (CAST(1 AS DOUBLE) / (n - 1)) END AS pct_first,
  CASE WHEN n = 1 THEN CAST(0 AS DOUBLE) WHEN li = n - 1 THEN CAST(1 AS DOUBLE) ELSE li * (CAST(1 AS DOUBLE) / (n - 1)) END AS pct_last
FROM g""", "trace"))
def q_reuse_cdf_kblocks(spark, sf):
    w7 = reuse.all_reuse_volume(V.trace(spark, sf), TO)
    return cdf.percent_cdf(w7.withColumn("kb", F.col("distance") / F.lit(1000.0)), "kb", ["opcode"],
                           out="kblocks", stop=1.0)


# ------------------------------------------------------------ W12 (exact)
from iolens.operators.unique_distance import unique_reuse_distance  # noqa: E402

W12_SQL = SEQ_TRACE + f"""
, e AS ({exploded('r', 'cover', 'opcode, device_id, seq')}),
  a AS (SELECT opcode, device_id, block, seq,
               lag(seq) OVER (PARTITION BY opcode, device_id, block ORDER BY seq) AS p,
               row_number() OVER (PARTITION BY opcode, device_id, block ORDER BY seq) AS acc FROM e)"""


def _w12_select(where):
    return f"""
SELECT q.opcode, q.device_id, q.block, q.seq,
       (SELECT count(*) FROM (SELECT DISTINCT e.device_id, e.block FROM e
         WHERE e.opcode = q.opcode AND e.seq > q.p AND e.seq < q.seq)) AS distance
FROM (SELECT * FROM a WHERE {where}) q"""


@register("unique_reuse_distance", with_views(W12_SQL + _w12_select("p IS NOT NULL"), "trace"))
def q_unique_reuse_distance(spark, sf):
    return unique_reuse_distance(V.trace(spark, sf), TO)


@register("unique_first_reuse_distance", with_views(W12_SQL + _w12_select("acc = 2"), "trace"))
def q_unique_first_reuse_distance(spark, sf):
    return unique_reuse_distance(V.trace(spark, sf), TO, first_only=True)


def _w12_cells(cells: str, where: str, seq: str) -> str:
    """W12 in each cell; ``cells``: a cell's columns."""
    on = " AND ".join(f"e.{c} = q.{c}" for c in cells.split(", "))
    of = ", ".join(dict.fromkeys([*cells.split(", "), "opcode", "device_id", "block"]))
    return seq + f"""
, e AS ({exploded('r', 'cover', ", ".join(dict.fromkeys([*cells.split(", "), "opcode", "device_id", "seq"])))}),
  a AS (SELECT *, lag(seq) OVER (PARTITION BY {of} ORDER BY seq) AS p, row_number() OVER (PARTITION BY {of} ORDER BY seq) AS acc FROM e)
SELECT {", ".join("q." + c for c in of.split(", "))}, q.seq,
       (SELECT count(*) FROM (SELECT DISTINCT e.device_id, e.block FROM e
         WHERE {on} AND e.opcode = q.opcode AND e.seq > q.p AND e.seq < q.seq)) AS distance
FROM (SELECT * FROM a WHERE {where}) q"""


SEQ_DEVICE = """, r AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY "timestamp", tie) - 1 AS seq FROM trace)"""


@register("unique_reuse_distance_per_device", with_views(_w12_cells("device_id", "p IS NOT NULL", SEQ_DEVICE), "trace"))
def q_unique_reuse_distance_per_device(spark, sf):
    return unique_reuse_distance(V.trace(spark, sf), TO, keys=["device_id"])


# --------------------------------------------- keyed by device (per-device runs)
@register("all_reuse_volume_per_device", with_views(volume("floor", per="device_id, opcode") + """
SELECT device_id, opcode, block, seq, distance FROM v WHERE ps IS NOT NULL""", "trace"))
def q_all_reuse_volume_per_device(spark, sf):
    return reuse.all_reuse_volume(V.trace(spark, sf), TO, keys=["device_id"])
