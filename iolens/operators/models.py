"""Clustering and projection (M2-M5) on feature tables.

A feature table has one row per device or per time window. The passes over it
are a covariance aggregate and, for k-means, one stage each without a shuffle: tasks fold their rows
into the farthest point, or into sums by label. The driver holds what is small
whatever the table: a matrix of the columns, the centres, a few sums a task. Everything is deterministic, so a fit can be repeated by other means.

k-means starts at far points: the row with the smallest values, then again and
again the row farthest from the seeds so far (ties: smallest values). Exact Lloyd
steps follow (ties: lowest cluster), until no centre moves or ``STEPS`` times; a cluster that
loses all its rows is dropped. The seeds of k clusters are the first k of those
of more, and the steps of several k share one pass. Rows with a null or NaN
coordinate take no part in a fit and have no label.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iolens.plans.order import materialized

STEPS = 30
#: a centre that moves less, relative to its size, has only met another order of summation
STILL = 1e-12

Centres = dict[int, tuple[float, ...]]


# ------------------------------------------------------------------------ PCA

def pca_fit(df: DataFrame, cols, k: int = 2) -> np.ndarray:
    """The first k principal axes (k x p) of the columns' covariance, each with its
    largest absolute loading positive."""
    cols = list(cols)
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    got = df.agg(*[F.covar_samp(cols[i], cols[j]) for i, j in pairs]).first()
    cov = np.zeros((len(cols), len(cols)))
    for (i, j), v in zip(pairs, got):
        cov[i, j] = cov[j, i] = v if v is not None and not math.isnan(v) else 0.0
    _, axes = np.linalg.eigh(cov)  # ascending
    axes = axes.T[::-1][:k]
    return axes * np.array([1.0 if a[np.abs(a).argmax()] >= 0 else -1.0 for a in axes])[:, None]


def pca_project(df: DataFrame, cols, keys=(), k: int = 2) -> DataFrame:
    """M2: the first k principal components of every row (columns are standardized already)."""
    df = materialized(df)
    axes = pca_fit(df, cols, k)
    mean = df.agg(*[F.avg(c) for c in cols]).first()
    return df.select(*list(keys), *[
        sum(((F.col(c) - F.lit(float(m or 0.0))) * F.lit(float(x)) for c, m, x in zip(cols, mean, axis)), F.lit(0.0)).alias(f"pca{j + 1}")
        for j, axis in enumerate(axes)])


def pca_loadings(df: DataFrame, cols, k: int = 2) -> DataFrame:
    """M2: k x p loading matrix, one row per component."""
    axes = pca_fit(materialized(df), cols, k)
    rows = [(f"PCA{j + 1}", *map(float, a)) for j, a in enumerate(axes)]
    return df.sparkSession.createDataFrame(rows, ", ".join(["component string", *[f"`{c}` double" for c in cols]]))


# --------------------------------------------------------------------- k-means

def _usable(df: DataFrame, cols) -> DataFrame:
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return df.filter(ok)


def distance2(cols, centre) -> Column:
    """Squared distance of a row to a centre: numbers, or an array column."""
    at = [F.lit(float(v)) for v in centre] if not isinstance(centre, Column) else [F.get(centre, F.lit(j)) for j in range(len(cols))]
    parts = [(F.col(c) - v) * (F.col(c) - v) for c, v in zip(cols, at)]
    return sum(parts[1:], parts[0])


def _literal(rows) -> Column:
    """Rows of numbers as one literal array, so that expressions don't grow with their number."""
    return F.expr("array(" + ", ".join("array(" + ", ".join(f"{float(v)!r}D" for v in r) + ")" for r in rows) + ")")


def _nearest(cols, centres: Centres) -> tuple[Column, Column]:
    """Label and squared distance of the nearest centre, the lowest label of equals."""
    cols = list(cols)
    known = _literal([(*c, k) for k, c in sorted(centres.items())])
    best = F.array_min(F.transform(known, lambda c: F.struct(distance2(cols, c).alias("d"), F.get(c, F.lit(len(cols))).cast("int").alias("k"))))
    return best["k"], best["d"]


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances (rows x centres), summed column by column as ``distance2`` does."""
    d = np.zeros((len(x), len(centres)))
    for c in range(x.shape[1]):
        d += (x[:, c, None] - centres[None, :, c]) ** 2
    return d


def _folded(df: DataFrame, cols, schema: str, first, fold, out) -> list:
    """One pass over the rows: each task folds its batches (rows x columns) into one
    state, of which ``out`` makes a few rows for the driver."""
    cols = list(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = first()
        for b in batches:
            state = fold(state, np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in cols]))
        rows = out(state)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=[f.split()[0] for f in schema.split(", ")])

    return df.select(*cols).mapInArrow(run, schema).collect()


def far_points(df: DataFrame, cols, k: int) -> list[tuple[float, ...]]:
    """Up to k different rows: the smallest, then each time the one farthest from
    those so far, the smallest of equals. A task gives one row."""
    seeds: list[tuple[float, ...]] = []
    while len(seeds) < k:
        known = np.array(seeds)

        def fold(best, x):
            far = -_distances(x, known).min(axis=1) if len(known) else np.zeros(len(x))
            at = np.flatnonzero(far == far.min()) if len(x) else []
            return min([best, *((float(far[i]), *x[i].tolist()) for i in at)], key=lambda r: r or (math.inf,)) if len(at) else best

        got = _folded(df, cols, "point array<double>", tuple, fold, lambda best: [(list(best),)] if best else [])
        best = min((tuple(r["point"]) for r in got), default=None)
        if best is None or seeds and best[0] == 0:
            break
        seeds.append(best[1:])
    return seeds


def _sums(df: DataFrame, cols, fits: dict[int, Centres]) -> dict[int, dict[int, tuple[int, float, np.ndarray]]]:
    """By fit and centre: number, squared distances and column sums of the rows nearest
    to it (the lowest of equals). A task gives one row for each centre."""
    known = {k: (sorted(c), np.array([c[i] for i in sorted(c)])) for k, c in fits.items()}

    def fold(state, x):
        for k, (names, centres) in known.items():
            d = _distances(x, centres)
            label = d.argmin(axis=1)
            near = d[np.arange(len(x)), label]
            for i in np.unique(label).tolist():
                mine = label == i
                n, e, s = state.get((k, names[i]), (0, 0.0, 0.0))
                state[k, names[i]] = n + int(mine.sum()), e + float(near[mine].sum()), s + x[mine].sum(axis=0)
        return state

    got = _folded(df, cols, "fit long, cluster long, n long, e double, s array<double>", dict, fold,
                  lambda state: [(*key, n, e, s.tolist()) for key, (n, e, s) in state.items()])
    out: dict[int, dict[int, tuple[int, float, np.ndarray]]] = {k: {} for k in fits}
    for r in got:
        n, e, s = out[r["fit"]].get(r["cluster"], (0, 0.0, 0.0))
        out[r["fit"]][r["cluster"]] = n + r["n"], e + r["e"], s + np.array(r["s"])
    return out


def lloyd(df: DataFrame, cols, starts: dict[int, Centres], steps: int = STEPS) -> dict[int, Centres]:
    """The centres of several fits (by their k), a pass over the rows for each step of all of them."""
    now, moving = dict(starts), set(starts)
    for _ in range(steps):
        if not moving:
            break
        for k, sums in _sums(df, cols, {k: now[k] for k in moving}).items():
            old, new = now[k], {c: tuple((s / n).tolist()) for c, (n, _, s) in sums.items()}
            if new.keys() == old.keys() and all(abs(a - b) <= STILL * max(1.0, abs(a)) for c in new for a, b in zip(new[c], old[c])):
                moving.discard(k)
            now[k] = new
    return now


def kmeans_fit(df: DataFrame, cols, ks: Iterable[int]) -> tuple[dict[int, Centres], DataFrame]:
    """The centres for each k that the rows have enough different points for, and the rows that took part."""
    data = materialized(_usable(df, cols))
    ks = sorted(set(ks))
    rows = data.select(*[F.col(c).cast("double").alias(c) for c in cols]).persist()  # every step reads them; what is lost is read again
    try:
        seeds = far_points(rows, cols, max(ks))
        return lloyd(rows, cols, {k: dict(enumerate(seeds[:k])) for k in ks if k <= len(seeds)}), data
    finally:
        rows.unpersist()


def kmeans_labels(df: DataFrame, cols, k: int, keys=()) -> DataFrame:
    """M3/M4: cluster label per row; null for a row with a missing coordinate."""
    df = materialized(df)
    fit = kmeans_fit(df, cols, [k])[0].get(k)
    missing = F.lit(False)
    for c in cols:
        missing = missing | F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    label = F.when(~missing, _nearest(cols, fit)[0]) if fit else F.lit(None).cast("int")
    return df.select(*list(keys), *cols, label.alias("cluster"))


def kmeans_centers(df: DataFrame, cols, k: int) -> DataFrame:
    """M4: centroids, one row per cluster."""
    fit = kmeans_fit(df, cols, [k])[0].get(k, {})
    return df.sparkSession.createDataFrame([(c, *v) for c, v in sorted(fit.items())], ", ".join(["cluster int", *[f"`{c}` double" for c in cols]]))


def kmeans_elbow(df: DataFrame, cols, ks=range(2, 12)) -> DataFrame:
    """M5: within-cluster sum of squares for each k (k >= distinct points skipped)."""
    ks = list(ks)
    fits, data = kmeans_fit(df, cols, [*ks, max(ks) + 1])
    # k + 1 far points show that there are more different rows than k
    most = max(fits, default=0)
    distinct = most if most == max(ks) + 1 else data.select(*cols).distinct().count()
    ks = [k for k in ks if k in fits and k < distinct]
    if not ks:
        return df.sparkSession.createDataFrame([], "k int, sse double")
    sse = _sums(data.select(*[F.col(c).cast("double").alias(c) for c in cols]), cols, {k: fits[k] for k in ks})
    return df.sparkSession.createDataFrame([(k, float(sum(e for _, e, _ in sse[k].values()))) for k in ks], "k int, sse double")
