"""Modelling queries (M2-M8). M6/M7 have SQL oracles; the fits are checked by tests and
by ``*_check`` queries on what must hold of any fit."""

from __future__ import annotations

from pyspark.sql import functions as F

from iolens.operators import features, models, series
from iolens.plans.order import materialized
from iolens.queries import register
from iolens.queries.aggregates import A15_SQL, IA_SQL
from iolens.sources import views as V
from iolens.sources.views import with_views

DF = list(features.DEVICE_FEATURES)
WF = list(features.WINDOW_FEATURES)
ZDF = ["z_" + c for c in DF]
ZWF = ["z_" + c for c in WF]
DIGITS = 6  # inputs and results of the fits are rounded so that both engines meet the same numbers


def _rounded(df, cols, digits: int = DIGITS):
    # adding zero turns -0.0 into 0.0
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if c in cols else F.col(c) for c in df.columns])


def _dev_z(spark, sf):
    f = features.device_features(V.trace(spark, sf), V.TRACE_ORDER)
    return _rounded(features.standardize(f, DF), ZDF)


def _win_z(spark, sf):
    f = features.window_features(V.trace(spark, sf), V.TRACE_ORDER)
    return _rounded(features.standardize(f, WF), ZWF)


# ---------------------------------------------------- the fits, repeated in DuckDB
def _recursive(sql: str) -> str:
    return with_views(sql, "trace").replace("WITH ", "WITH RECURSIVE ", 1)


def _z_table(features_sql: str, source: str, keys: str, cols) -> str:
    """CTE ``z``: the keys and the columns' z-scores."""
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in cols)
    zs = ", ".join(f"round(CASE WHEN s_{c} IS NULL OR s_{c} = 0 THEN CAST(0 AS DOUBLE) ELSE ({c} - m_{c}) / s_{c} END, {DIGITS}) + 0 AS z_{c}" for c in cols)
    return features_sql + f"""
, zst AS (SELECT {stats} FROM {source}),
  z AS (SELECT {keys}, {zs} FROM {source} CROSS JOIN zst)"""


Z_DEVICES = _z_table(A15_SQL, "a15", "device_id", DF)
Z_WINDOWS = _z_table(IA_SQL + """
, a16 AS (SELECT device_id, "timestamp" // 3600000000 AS time_window, count(*) AS avg_io_count,
                 sum("length") / count(*) AS avg_io_size, coalesce(stddev_samp("length"), 0) AS io_size_std,
                 sum(opi) / count(opi) AS read_write_ratio, sum(ia) / count(ia) AS avg_response_time,
                 sum(ia) / count(ia) AS interval_mean, coalesce(stddev_samp(ia), 0) AS interval_std FROM ia GROUP BY 1, 2)""",
    "a16", "device_id, time_window", WF)


def _axis_sql(name: str, matrix: str, p: int) -> str:
    """CTE ``name``: (i, x), the dominant eigenvector of ``matrix`` (i, j, v): its 16th power times a vector, again and again."""
    out, last = "", matrix
    for k in (2, 4, 8, 16):
        out += f"""
, {name}_m{k} AS (SELECT i, j, v / (SELECT sum(a.v * b.v) FROM {last} a JOIN {last} b ON a.j = b.i WHERE a.i = b.j) AS v
       FROM (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {last} a JOIN {last} b ON a.j = b.i GROUP BY 1, 2))"""
        last = f"{name}_m{k}"
    return out + f"""
, {name}_v AS (SELECT 0 AS step, i, CAST(1 AS DOUBLE) / (i + 1) AS x FROM (SELECT unnest(range({p})) AS i)
    UNION ALL SELECT step + 1, i, x / sqrt(sum(x * x) OVER ())
      FROM (SELECT w.step, m.i, sum(m.v * w.x) AS x FROM {name}_v w JOIN {last} m ON m.j = w.i WHERE w.step < 200 GROUP BY 1, 2)),
  {name} AS (SELECT i, x * sign((SELECT arg_max(x, abs(x)) FROM {name}_v WHERE step = 200)) AS x FROM {name}_v WHERE step = 200)"""


def _pca_ctes(cols) -> str:
    """CTEs ``e1`` and ``e2`` over ``z``: the first two axes of the covariance, by deflated power iteration."""
    p = len(cols)
    cov = ", ".join(f"covar_samp({a}, {b})" for a in cols for b in cols)
    return f"""
, cov AS (SELECT k // {p} AS i, k % {p} AS j, v FROM (SELECT unnest(range({p * p})) AS k, unnest([{cov}]) AS v FROM z)){_axis_sql("e1", "cov", p)}
, l1 AS (SELECT sum(a.x * cov.v * b.x) AS l FROM cov JOIN e1 a ON a.i = cov.i JOIN e1 b ON b.i = cov.j),
  cov2 AS (SELECT cov.i, cov.j, cov.v - l1.l * a.x * b.x AS v FROM cov JOIN e1 a ON a.i = cov.i JOIN e1 b ON b.i = cov.j CROSS JOIN l1){_axis_sql("e2", "cov2", p)}"""


def _loading(name: str, axis: str, cols) -> str:
    return f"SELECT '{name}' AS component, " + ", ".join(f"round(max(x) FILTER (WHERE i = {k}), {DIGITS}) + 0 AS {c}" for k, c in enumerate(cols)) + f" FROM {axis}"


def _projected(cols) -> str:
    """CTE ``pc``: device_id, pca1, pca2."""
    means = ", ".join(f"avg({c}) AS m_{c}" for c in cols)

    def dot(axis):
        return " + ".join(f"({c} - m_{c}) * (SELECT x FROM {axis} WHERE i = {k})" for k, c in enumerate(cols))
    return f"""
, zm AS (SELECT {means} FROM z),
  pc AS (SELECT device_id, round({dot("e1")}, {DIGITS}) + 0 AS pca1, round({dot("e2")}, {DIGITS}) + 0 AS pca2 FROM z CROSS JOIN zm)"""


def _kmeans_ctes(source: str, keys: str, cols, ks) -> str:
    """CTEs over ``source``: ``pts`` (keys, pid, x0..), ``lk`` (it, k, label, f0..): the
    centres after each Lloyd step from far-point seeds, and ``near`` (k, pid, label, d) after the last."""
    n = range(len(cols))
    xs, fs = ", ".join(f"x{c}" for c in n), ", ".join(f"f{c}" for c in n)

    def d2(f: str, p: str = ""):
        return " + ".join(f"({p}x{c} - {f}{c}) * ({p}x{c} - {f}{c})" for c in n)
    picked = ", ".join(f"first_value(x{c}) OVER w AS f{c}" for c in n)
    new = ", ".join(f"first_value(x{c}) OVER w AS g{c}" for c in n)
    nearest = f"min({{'d': {d2('lk.f', 'p.')}, 'l': lk.label}})"
    return f"""
, pts AS (SELECT {keys}, row_number() OVER () AS pid, {", ".join(f"{c} AS x{k}" for k, c in enumerate(cols))} FROM {source}),
  sd AS (SELECT 1 AS step, {xs}, {fs}, {d2('f')} AS near FROM (SELECT {xs}, {picked} FROM pts WINDOW w AS (ORDER BY {xs}))
    UNION ALL SELECT step + 1, {xs}, {", ".join(f"g{c}" for c in n)}, least(near, {d2('g')})
      FROM (SELECT *, {new} FROM sd WHERE step < {max(ks)} WINDOW w AS (ORDER BY near DESC, {xs}))),
  lk AS (SELECT 0 AS it, k, CAST(step - 1 AS BIGINT) AS label, {fs} FROM (SELECT DISTINCT step, {fs} FROM sd) JOIN (SELECT unnest([{", ".join(map(str, ks))}]) AS k) ON step <= k
    UNION ALL SELECT it + 1, k, label, {", ".join(f"avg(x{c})" for c in n)}
      FROM (SELECT it, k, pid, {nearest}.l AS label, {", ".join(f"any_value(p.x{c}) AS x{c}" for c in n)}
            FROM lk CROSS JOIN pts p WHERE it < {models.STEPS} GROUP BY it, k, pid) GROUP BY it, k, label),
  near AS (SELECT k, pid, m.l AS label, m.d AS d FROM (SELECT k, pid, {nearest} AS m FROM lk CROSS JOIN pts p WHERE it = {models.STEPS} GROUP BY k, pid))"""


_PCA = Z_DEVICES + _pca_ctes(ZDF)


@register("pca_project", _recursive(_PCA + _projected(ZDF) + "\nSELECT * FROM pc"))
def q_pca_project(spark, sf):
    return _rounded(models.pca_project(_dev_z(spark, sf), ZDF, keys=["device_id"]), ["pca1", "pca2"])


@register("pca_loadings", _recursive(_PCA + "\n" + _loading("PCA1", "e1", ZDF) + " UNION ALL " + _loading("PCA2", "e2", ZDF)))
def q_pca_loadings(spark, sf):
    return _rounded(models.pca_loadings(_dev_z(spark, sf), ZDF), ZDF)


@register("kmeans_windows", _recursive(Z_WINDOWS + _kmeans_ctes("z", "device_id, time_window", ZWF, [6]) + f"""
SELECT device_id, time_window, {", ".join(f"x{k} AS {c}" for k, c in enumerate(ZWF))}, label AS cluster FROM pts JOIN near USING (pid)"""))
def q_kmeans_windows(spark, sf):
    return models.kmeans_labels(_win_z(spark, sf), ZWF, 6, keys=["device_id", "time_window"])


_DEVICE_CLUSTERS = _PCA + _projected(ZDF) + _kmeans_ctes("pc", "device_id", ["pca1", "pca2"], [4])


@register("kmeans_devices", _recursive(_DEVICE_CLUSTERS + """
SELECT device_id, x0 AS pca1, x1 AS pca2, label AS cluster FROM pts JOIN near USING (pid)"""))
def q_kmeans_devices(spark, sf):
    return models.kmeans_labels(q_pca_project(spark, sf), ["pca1", "pca2"], 4, keys=["device_id"])


@register("kmeans_centers", _recursive(_DEVICE_CLUSTERS + f"""
SELECT label AS cluster, round(f0, {DIGITS}) + 0 AS pca1, round(f1, {DIGITS}) + 0 AS pca2 FROM lk WHERE it = {models.STEPS}"""))
def q_kmeans_centers(spark, sf):
    return _rounded(models.kmeans_centers(q_pca_project(spark, sf), ["pca1", "pca2"], 4), ["pca1", "pca2"])


@register("kmeans_elbow", _recursive(Z_WINDOWS + _kmeans_ctes("z", "device_id, time_window", ZWF, list(range(2, 12))) + """
SELECT k, round(sum(d), 4) AS sse FROM near GROUP BY k"""))
def q_kmeans_elbow(spark, sf):
    return _rounded(models.kmeans_elbow(_win_z(spark, sf), ZWF, range(2, 12)), ["sse"], 4)


M6_SQL = """
, a AS (SELECT device_id, "timestamp" - "timestamp" % 3600000000 AS hour, sum("length") / count(*) AS mean_size
        FROM trace GROUP BY 1, 2),
  b AS (SELECT device_id, min(hour) AS lo, max(hour) AS hi, count(*) AS k FROM a GROUP BY 1),
  g AS (SELECT device_id, unnest(generate_series(lo, hi, 3600000000)) AS hour FROM b),
  m6 AS (SELECT g.device_id, g.hour, a.mean_size FROM g LEFT JOIN a USING (device_id, hour))"""


@register("hourly_series_filled", with_views(M6_SQL + "\nSELECT * FROM m6", "trace"))
def q_hourly_series_filled(spark, sf):
    return series.hourly_series_filled(V.trace(spark, sf))


@register("chrono_split", with_views(M6_SQL + """
, n AS (SELECT device_id, min(hour) AS h0, count(*) AS n FROM m6 GROUP BY 1)
SELECT m6.device_id, m6.hour, m6.mean_size,
       CASE WHEN (m6.hour - n.h0) // 3600000000 < CAST(trunc(n.n * CAST(0.8 AS DOUBLE)) AS BIGINT)
            THEN 'train' ELSE 'test' END AS split
FROM m6 JOIN n USING (device_id)""", "trace"))
def q_chrono_split(spark, sf):
    return series.chrono_split(series.hourly_series_filled(V.trace(spark, sf)))


@register("forecast_hourly")
def q_forecast_hourly(spark, sf):
    return series.forecast_hourly(V.trace(spark, sf))


@register("forecast_hourly_check", with_views(M6_SQL + """
, n AS (SELECT device_id, min(hour) AS h0, count(*) AS n FROM m6 GROUP BY 1)
SELECT m6.device_id, m6.hour, m6.mean_size AS actual, true AS bounded
FROM m6 JOIN n USING (device_id)
WHERE (m6.hour - n.h0) // 3600000000 >= CAST(trunc(n.n * CAST(0.8 AS DOUBLE)) AS BIGINT)""", "trace"))
def q_forecast_hourly_check(spark, sf):
    """M8: keys, hours and actual values, and that no forecast leaves ten times the largest training value."""
    t = materialized(V.trace(spark, sf).select("device_id", "timestamp", "length"))
    train = series.chrono_split(series.hourly_series_filled(t)).filter("split = 'train'")
    top = train.groupBy("device_id").agg(F.max(F.abs("mean_size")).alias("top"))
    f = series.forecast_hourly(t)
    return f.join(top, "device_id").select("device_id", "hour", "actual", (F.abs("forecast") <= 10 * F.col("top")).alias("bounded"))


# ------------------------------------------- invariants of the fits, against true
DEVICES_SQL = "SELECT DISTINCT device_id, true AS holds FROM trace"


def _nearest(cols, centres):
    """Whether each row's label is its nearest centre (to rounding)."""
    own = F.element_at(F.map_from_arrays(F.array(*[F.lit(k) for k in centres]), F.array(*[models.distance2(cols, c) for c in centres.values()])), F.col("cluster"))
    return own <= F.least(*[models.distance2(cols, c) for c in centres.values()], F.lit(float("inf"))) + 1e-9


@register("pca_check", with_views("""
SELECT device_id, true AS holds FROM (SELECT DISTINCT device_id FROM trace)""", "trace"))
def q_pca_check(spark, sf):
    """M2: loadings are orthonormal and a projection is the loadings' product with the z-scores."""
    z = materialized(_dev_z(spark, sf))
    load = [[r[c] for c in ZDF] for r in models.pca_loadings(z, ZDF).orderBy("component").collect()]  # two rows
    dot = [[sum(a * b for a, b in zip(x, y)) for y in load] for x in load]
    fine = all(abs(dot[i][j] - (i == j)) < 1e-9 for i in range(2) for j in range(2))
    p = models.pca_project(z, ZDF, keys=["device_id", *ZDF])
    same = [F.abs(sum((F.col(c) * F.lit(v) for c, v in zip(ZDF, load[i])), F.lit(0.0)) - F.col(f"pca{i + 1}")) < 1e-6 for i in range(2)]
    return p.select("device_id", (same[0] & same[1] & F.lit(fine)).alias("holds"))


@register("kmeans_devices_check", with_views(DEVICES_SQL, "trace"))
def q_kmeans_devices_check(spark, sf):
    """M4: every device's label is its nearest centre."""
    p = materialized(q_pca_project(spark, sf))
    fits, _ = models.kmeans_fit(p, ["pca1", "pca2"], [4])
    return models.kmeans_labels(p, ["pca1", "pca2"], 4, keys=["device_id"]).select("device_id", _nearest(["pca1", "pca2"], fits[4]).alias("holds"))


@register("kmeans_windows_check", with_views("""
SELECT device_id, "timestamp" // 3600000000 AS time_window, true AS holds FROM trace GROUP BY 1, 2""", "trace"))
def q_kmeans_windows_check(spark, sf):
    """M3: every window's label is its nearest centre."""
    z = materialized(_win_z(spark, sf))
    fits, _ = models.kmeans_fit(z, ZWF, [6])
    return (models.kmeans_labels(z, ZWF, 6, keys=["device_id", "time_window"])
            .select("device_id", "time_window", _nearest(ZWF, fits[6]).alias("holds")))


@register("kmeans_elbow_check", "SELECT unnest(generate_series(2, 11)) AS k, true AS holds")
def q_kmeans_elbow_check(spark, sf):
    """M5: each cost is the sum of squares recomputed from the labels."""
    z = materialized(_win_z(spark, sf))
    cost = {r["k"]: r["sse"] for r in models.kmeans_elbow(z, ZWF, range(2, 12)).collect()}
    fits, data = models.kmeans_fit(z, ZWF, range(2, 12))
    sse = data.agg(*[F.sum(models._nearest(ZWF, fits[k])[1]).alias(str(k)) for k in cost]).first()
    return spark.createDataFrame([(k, abs(sse[str(k)] - v) <= 1e-6 * v) for k, v in cost.items()], "k long, holds boolean")
