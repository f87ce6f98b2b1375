"""Model operators on planted data (labels compared as partitions, never ids)."""

import numpy as np

from iolens.operators import features, models, series


def test_standardize_population_std(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 5.0)], "k int, a double, b double")
    r = {x.k: x for x in features.standardize(df, ["a", "b"]).collect()}
    assert r[1].z_a == -1.0 and r[2].z_a == 1.0 and r[1].z_b == 0.0


def test_kmeans_recovers_planted_clusters(spark):
    rng = np.random.default_rng(0)
    centers = [(0, 0), (10, 10), (0, 10)]
    rows = [(i, float(cx + rng.normal(0, .3)), float(cy + rng.normal(0, .3)), c)
            for i in range(90) for c, (cx, cy) in [(i % 3, centers[i % 3])]]
    df = spark.createDataFrame(rows, "id int, x double, y double, truth int")
    lab = models.kmeans_labels(df, ["x", "y"], 3, keys=["id", "truth"]).toPandas()
    assert lab.groupby("truth")["cluster"].nunique().max() == 1
    assert lab.groupby("cluster")["truth"].nunique().max() == 1


def test_pca_loadings_orthonormal(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 4))
    x[:, 1] = x[:, 0] * 2 + rng.normal(0, .1, 50)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double")
    z = features.standardize(df, ["a", "b", "c", "d"])
    L = models.pca_loadings(z, ["z_a", "z_b", "z_c", "z_d"]).toPandas().drop(columns="component").to_numpy()
    assert np.allclose(L @ L.T, np.eye(2), atol=1e-8)


def test_elbow_non_increasing(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in rng.normal(size=(60, 2))], "x double, y double")
    sse = [r.sse for r in sorted(models.kmeans_elbow(df, ["x", "y"], range(2, 7)).collect(), key=lambda r: r.k)]
    assert all(b <= a * 1.05 for a, b in zip(sse, sse[1:]))


def test_kmeans_steps_are_the_plain_algorithm(spark):
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(200, 3)) + rng.integers(0, 3, (200, 1)) * 3, 3)
    x[5], x[6] = x[4], x[4]  # repeated rows
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(999, None, 1.0, 1.0)], "id int, a double, b double, c double").repartition(4)
    seeds = [min(map(tuple, x))]
    while len(seeds) < 5:
        d = np.min([((x - s) ** 2).sum(axis=1) for s in seeds], axis=0)
        seeds.append(min(tuple(r) for r, v in zip(x, d) if np.isclose(v, d.max(), rtol=0, atol=0)))
    centres = np.array(seeds)
    for _ in range(models.STEPS):
        label = ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([x[label == k].mean(axis=0) for k in range(5)])
        if np.allclose(new, centres, rtol=0, atol=1e-13):
            break
        centres = new
    fits, data = models.kmeans_fit(df, ["a", "b", "c"], [5])
    assert data.count() == 200
    assert np.allclose([fits[5][k] for k in range(5)], centres, atol=1e-9)
    got = {r.id: r.cluster for r in models.kmeans_labels(df, ["a", "b", "c"], 5, keys=["id"]).collect()}
    assert got.pop(999) is None and [got[i] for i in range(200)] == ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1).tolist()
    sse = {r.k: r.sse for r in models.kmeans_elbow(df, ["a", "b", "c"], [5]).collect()}
    assert np.isclose(sse[5], ((x[:, None] - centres) ** 2).sum(axis=2).min(axis=1).sum())


def test_few_rows_and_no_rows(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0), (2.0, 2.0)], "a double, b double")
    assert [r.k for r in models.kmeans_elbow(df, ["a", "b"], range(1, 5)).collect()] == [1]
    assert {r.cluster for r in models.kmeans_labels(df, ["a", "b"], 3).collect()} == {None}
    empty = df.filter("a > 5")
    assert models.kmeans_elbow(empty, ["a", "b"]).count() == models.kmeans_centers(empty, ["a", "b"], 2).count() == models.pca_project(empty, ["a", "b"]).count() == 0


def test_wrong_fits_turn_the_sql_red(spark):
    """A rotated basis, a moved centre and a changed label differ from the SQL in the compared digits."""
    import oracle
    from iolens.queries import oracle_sql, queries
    sf = "/root/testdata/sf0.001"
    con = oracle.duck(sf)
    load, centres, labels = (queries()[n](spark, sf).toPandas() for n in ("pca_loadings", "kmeans_centers", "kmeans_devices"))
    want = {n: con.execute(oracle_sql()[n]).df() for n in ("pca_loadings", "kmeans_centers", "kmeans_devices")}
    for n, got in (("pca_loadings", load), ("kmeans_centers", centres), ("kmeans_devices", labels)):
        assert oracle.compare(got, want[n])[0], n
    turned = load.copy()
    c, s = np.cos(0.01), np.sin(0.01)
    turned.iloc[:, 1:] = np.array([[c, -s], [s, c]]) @ load.iloc[:, 1:].to_numpy()
    assert not oracle.compare(turned, want["pca_loadings"])[0]
    centres.loc[0, "pca1"] += 1e-5
    assert not oracle.compare(centres, want["kmeans_centers"])[0]
    labels.loc[0, "cluster"] = (labels.loc[0, "cluster"] + 1) % 4
    assert not oracle.compare(labels, want["kmeans_devices"])[0]


def test_forecast_beats_last_value():
    rng = np.random.default_rng(3)
    n = 600
    d = np.zeros(n)
    for t in range(2, n):
        d[t] = 0.6 * d[t - 1] - 0.3 * d[t - 2] + rng.normal()
    y = 100 + np.cumsum(d)
    tr, te = y[:480], y[480:]
    h = 1
    errs_model, errs_last = [], []
    for start in range(0, len(te) - h, 5):
        hist = np.concatenate([tr, te[:start]])
        f, _, _ = series.fit_forecast(hist, h, 2, 0)
        errs_model.append((f[-1] - te[start + h - 1]) ** 2)
        errs_last.append((hist[-1] - te[start + h - 1]) ** 2)
    assert np.mean(errs_model) < np.mean(errs_last)


def test_forecast_rows_per_test_hour(spark):
    import __spark_entry__ as e
    out = e.queries()["forecast_hourly"](spark, "/root/testdata/sf0.001").toPandas()
    split = e.queries()["chrono_split"](spark, "/root/testdata/sf0.001").toPandas()
    assert len(out) == (split["split"] == "test").sum()
    assert out["forecast"].notna().all()


def arma_series(rng, n, gaps=True):
    d, e = np.zeros(n), rng.normal(size=n)
    for t in range(2, n):
        d[t] = 0.5 * d[t - 1] - 0.2 * d[t - 2] + e[t] + 0.4 * e[t - 1]
    y = 500 + np.cumsum(d) * 0.3
    if gaps:
        y[rng.choice(n, n // 6, replace=False)] = np.nan
    return y


def test_forecast_with_gaps_ma_part_and_many_steps_stays_bounded():
    worse = 0
    for seed in range(8):
        rng = np.random.default_rng(seed)
        y = arma_series(rng, 500)
        train, test = y[:400], y[400:]
        f, p, q = series.fit_forecast(train, 100, 20, 15)
        assert len(f) == 100 and (p, q) in series.candidate_orders(20, 15)
        assert np.abs(f).max() <= 10 * np.nanmax(np.abs(train))
        last = train[~np.isnan(train)][-1]
        worse += np.nanmean(np.abs(f - test)) > np.nanmean(np.abs(last - test)) + 1e-9
    assert worse <= 4


def autocovariances(ar, ma, n, terms=4000):
    """Of an ARMA process with unit noise, by its weights on past noise."""
    psi = np.zeros(terms)
    for k in range(terms):
        psi[k] = (1.0 if k == 0 else ma[k - 1] if k <= len(ma) else 0.0) + sum(ar[j] * psi[k - 1 - j] for j in range(min(k, len(ar))))
    return np.array([psi[:terms - k] @ psi[k:] for k in range(n)])


def test_likelihood_is_the_multivariate_normals():
    rng = np.random.default_rng(5)
    for ar, ma, c in (([0.5, -0.3], [0.4], 0.2), ([], [0.7, 0.1], -1.0), ([0.8], [], 0.0), ([], [], 3.0)):
        d = rng.normal(size=40) * 2 + c
        d[[3, 4, 17, 39]] = np.nan
        fit = series.Fit(len(ar), len(ma), c, np.array(ar), np.array(ma), np.zeros(40))
        seen = np.flatnonzero(~np.isnan(d))
        g = autocovariances(ar, ma, 40)
        cov = g[np.abs(seen[:, None] - seen)]
        x = d[seen] - (c / (1 - sum(ar)))
        quad, n = x @ np.linalg.solve(cov, x), len(seen)
        want = -0.5 * (n * np.log(2 * np.pi * quad / n) + n + np.linalg.slogdet(cov)[1])
        assert np.isclose(series.log_likelihood(d, fit), want, rtol=1e-9)


def test_refined_fits_are_likelier_and_stay_stable():
    gained = 0
    for seed in range(5):
        d = np.diff(arma_series(np.random.default_rng(seed), 300))
        for p, q in ((2, 1), (1, 0), (0, 0), (3, 3)):
            start = series.fit_arma(d, p, q)
            if start is None:
                continue
            better = series.refined(d, start)
            assert series.log_likelihood(d, better) >= series.log_likelihood(d, start)
            gained += series.log_likelihood(d, better) > series.log_likelihood(d, start) + 1e-6
            assert series._stable(better.ar) and series._stable(-better.ma) and len(better.resid) == len(d)
    assert gained >= 5


def test_roll_out_starts_at_the_last_observed_hour():
    y = np.r_[np.arange(50.0), [np.nan] * 5]
    fit = series.fit_arma(np.diff(y), 1, 0)
    assert fit is None or fit.p == 1
    drift = series.Fit(0, 0, 1.0, np.array([]), np.array([]), np.zeros(len(y) - 1))
    assert series.roll_out(y, drift, 3).tolist() == [55.0, 56.0, 57.0]


def test_unstable_fits_are_rejected():
    y = 1.5 ** np.arange(40.0)
    assert not series._stable(np.array([1.5])) and series._stable(np.array([0.5, -0.2]))
    f, p, q = series.fit_forecast(y, 30, 2, 1)
    assert np.abs(f).max() <= 10 * y.max()


def test_forecast_is_no_worse_than_the_last_value_on_most_devices(spark):
    import __spark_entry__ as e
    sf = "/root/testdata/sf0.01"
    out = e.queries()["forecast_hourly"](spark, sf).toPandas()
    s = e.queries()["chrono_split"](spark, sf).toPandas()
    better = 0
    for d, g in out.groupby("device_id"):
        tr = s[(s.device_id == d) & (s.split == "train")].sort_values("hour").mean_size.dropna()
        mae = (g.forecast - g.actual).abs().mean()
        better += mae <= (tr.iloc[-1] - g.actual).abs().mean() + 1e-6
    assert better > out.device_id.nunique() / 2
    assert {"ar_order", "ma_order"} <= set(out.columns)
