"""Hourly series and forecasting (M6-M8).

The series is an aggregate (one value per key and hour), built by Spark from
the whole trace. The forecast re-aims the reference's ARIMA(p, 1, q) fit:
Hannan-Rissanen -- a long autoregression gives residual estimates, then
ordinary least squares on lags of the differenced series and of those
residuals -- fitted on the training part of each series inside
``applyInPandas`` keyed by the series key. Fits that are not stationary or not
invertible are rejected, and the orders are chosen on a held-out tail. The chosen
fit starts a search for a higher exact Gaussian likelihood, which a Kalman
recursion gives with hours missing. Each
group is one key's hourly series, bounded by the number of hours, not by the trace.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iolens.functions.time import unit_micros
from iolens.operators.cdf import join_on_keys
from iolens.operators.rates import hourly_mean_size
from iolens.plans.grid import fill_grid
from iolens.plans.order import join_null_safe, materialized

HOUR_US = unit_micros("hour")
TRAIN_SHARE = 0.8  # fixed value: first int(0.8 n) points train


def hourly_series_filled(df: DataFrame, keys=("device_id",)) -> DataFrame:
    """M6: A20 on a regular hourly grid per key; hours without requests are null."""
    keys = list(keys)
    a = materialized(hourly_mean_size(df, keys))  # read for the bounds and for the hours
    bounds = a.groupBy(*keys).agg(F.min("hour").alias("lo"), F.max("hour").alias("hi"))
    grid = fill_grid(bounds, keys, "lo", "hi", HOUR_US, "hour")
    return join_null_safe(grid, a, keys + ["hour"], "left")


def chrono_split(series: DataFrame, keys=("device_id",), share: float = TRAIN_SHARE) -> DataFrame:
    """M7: per key the first int(share * n) grid points are 'train', the rest 'test'."""
    keys = list(keys)
    b = series.groupBy(*keys).agg(F.min("hour").alias("__h0"), F.count(F.lit(1)).alias("__n"))
    j = join_on_keys(series, b, keys)
    idx = ((F.col("hour") - F.col("__h0")) / F.lit(HOUR_US)).cast("long")
    ntrain = (F.col("__n") * F.lit(share)).cast("long")
    return j.withColumn("split", F.when(idx < ntrain, "train").otherwise("test")).drop("__h0", "__n")


def _lagmat(x: np.ndarray, k: int) -> np.ndarray:
    """Column j holds x shifted by j+1 (NaN where unavailable)."""
    n = len(x)
    m = np.full((n, k), np.nan)
    for j in range(k):
        m[j + 1:, j] = x[: n - j - 1]
    return m


def _ols(y, x):
    ok = ~np.isnan(y) & ~np.isnan(x).any(axis=1)
    if ok.sum() <= 2 * (x.shape[1] + 1):
        return None, ok
    xx = np.column_stack([np.ones(ok.sum()), x[ok]])
    coef, *_ = np.linalg.lstsq(xx, y[ok], rcond=None)
    return coef, ok


def _stable(coef: np.ndarray) -> bool:
    """Whether the recursion x_t = sum coef_j x_(t-j) dies out."""
    if not len(coef):
        return True
    m = np.zeros((len(coef), len(coef)))
    m[0] = coef
    m[1:, :-1] += np.eye(len(coef) - 1)
    return bool(np.abs(np.linalg.eigvals(m)).max() < 0.999)


@dataclass
class Fit:
    """ARMA(p, q) on differences: intercept, AR and MA coefficients, residuals."""
    p: int
    q: int
    c: float
    ar: np.ndarray
    ma: np.ndarray
    resid: np.ndarray


def fit_arma(d: np.ndarray, p: int, q: int, long_ar: int | None = None) -> Fit | None:
    """Hannan-Rissanen fit; None if the data don't determine it, the AR part is not
    stationary or the MA part not invertible. Rows with a missing lag are left out."""
    e = np.full(len(d), np.nan)
    x = _lagmat(d, p)
    if q:
        m = long_ar or max(p + q, 10)
        a, ok = _ols(d, _lagmat(d, m)) if len(d) > m else (None, None)
        if a is None:
            return None
        e[ok] = d[ok] - np.column_stack([np.ones(ok.sum()), _lagmat(d, m)[ok]]) @ a
        x = np.column_stack([x, _lagmat(e, q)])
    b, ok = _ols(d, x)
    if b is None:
        return None
    ar, ma = b[1:1 + p], b[1 + p:]
    if not (_stable(ar) and _stable(-ma)):
        return None
    e[ok] = d[ok] - np.column_stack([np.ones(ok.sum()), x[ok]]) @ b
    return Fit(p, q, float(b[0]), ar, ma, e)


def innovations(d: np.ndarray, fit: Fit) -> tuple[np.ndarray, np.ndarray]:
    """One-step errors of ``d`` (NaN where missing) and their variances over that of the
    noise, by the Kalman recursion of the ARMA process in state space, started in its
    stationary distribution. A missing value is predicted over."""
    r = max(fit.p, fit.q + 1)
    move, load = np.zeros((r, r)), np.zeros(r)
    move[:fit.p, 0] = fit.ar
    move[:-1, 1:] += np.eye(r - 1)
    load[0], load[1:1 + fit.q] = 1.0, fit.ma
    noise = np.outer(load, load)
    spread, step = noise.copy(), move.copy()
    for _ in range(60):  # stationary covariance, twice as many terms each time
        more = step @ spread @ step.T
        spread = spread + more
        step = step @ step
        if np.abs(more).max() <= 1e-14 * np.abs(spread).max():
            break
    mean = fit.c / (1 - fit.ar.sum()) if fit.p else fit.c
    state = np.zeros(r)
    error, scale = np.full(len(d), np.nan), np.full(len(d), np.nan)
    for t, x in enumerate(d - mean):
        if not np.isnan(x):
            error[t], scale[t] = x - state[0], spread[0, 0]
            gain = spread[:, 0] / scale[t]
            state = state + gain * error[t]
            spread = spread - np.outer(gain, spread[0])
        state, spread = move @ state, move @ spread @ move.T + noise
    return error, scale


def log_likelihood(d: np.ndarray, fit: Fit) -> float:
    """Exact Gaussian log-likelihood of the observed ``d``, at the noise variance that maximises it."""
    error, scale = innovations(d, fit)
    seen = ~np.isnan(error)
    n = int(seen.sum())
    if not n or (scale[seen] <= 0).any():
        return -np.inf
    variance = float(np.mean(error[seen] ** 2 / scale[seen]))
    return -np.inf if variance <= 0 else -0.5 * (n * np.log(2 * np.pi * variance) + n + float(np.log(scale[seen]).sum()))


#: likelihoods tried for one fit
TRIES = 200


def refined(d: np.ndarray, fit: Fit, tries: int = TRIES) -> Fit:
    """A fit of the same orders whose likelihood is not below ``fit``'s: parameters are
    moved one by one, by less when nothing helps; only stationary and invertible ones count."""
    values = np.concatenate(([fit.c], fit.ar, fit.ma))
    size = np.concatenate(([max(abs(fit.c), float(np.nanstd(d)) * 0.1, 1e-9)], np.full(fit.p + fit.q, 0.1)))

    def of(v: np.ndarray) -> Fit:
        return Fit(fit.p, fit.q, float(v[0]), v[1:1 + fit.p], v[1 + fit.p:], fit.resid)

    best, left = log_likelihood(d, fit), tries
    smallest = size * 1e-3
    while left > 0 and (size > smallest).all():
        gained = False
        for k in range(len(values)):
            for sign in (1, -1):
                v = values.copy()
                v[k] += sign * size[k]
                trial = of(v)
                if left <= 0 or not (_stable(trial.ar) and _stable(-trial.ma)):
                    continue
                left -= 1
                value = log_likelihood(d, trial)
                if value > best:
                    best, values, gained = value, v, True
                    break
        if not gained:
            size = size / 2
    out = of(values)
    out.resid = innovations(d, out)[0]
    return out


def roll_out(y: np.ndarray, fit: Fit | None, steps: int) -> np.ndarray:
    """Levels of the ``steps`` hours after the last one of ``y``. The recursion
    starts at the last observed hour, so hours missing at the end are forecast
    too; before it, a missing difference counts as its expectation."""
    seen = np.flatnonzero(~np.isnan(y))
    if not len(seen):
        return np.full(steps, np.nan)
    last = int(seen[-1])
    if fit is None:
        return np.full(steps, y[last])
    mean = fit.c / (1 - fit.ar.sum()) if fit.p else fit.c
    d = np.diff(y[:last + 1])
    dh = [mean if np.isnan(v) else v for v in d[::-1][:fit.p]] + [mean] * max(0, fit.p - len(d))
    eh = [0.0 if np.isnan(v) else v for v in fit.resid[:last][::-1][:fit.q]] + [0.0] * max(0, fit.q - last)
    level, out = float(y[last]), []
    for _ in range(len(y) - 1 - last + steps):
        step = fit.c + float(np.dot(fit.ar, dh)) + float(np.dot(fit.ma, eh))
        level += step
        out.append(level)
        dh, eh = [step, *dh][:fit.p], [0.0, *eh][:fit.q]
    return np.array(out[len(out) - steps:])


def candidate_orders(p: int, q: int) -> list[tuple[int, int]]:
    """The wanted orders and their halvings, down to a plain mean of differences."""
    out = [(p, q)]
    while (p, q) != (0, 0):
        p, q = p // 2, q // 2
        out.append((p, q))
    return out


def fit_forecast(values: np.ndarray, steps: int, p: int, q: int) -> tuple[np.ndarray, int, int]:
    """ARIMA(p', 1, q') forecast of ``values`` (NaN = missing) ``steps`` hours ahead,
    and the orders used. The orders are chosen among the wanted ones and their
    halvings on a tail of the training part (its last fifth, at most ``steps``
    hours), by mean absolute error, against repeating the last value, which has
    orders (0, 0) and is used when no stable fit does better. Forecasts that leave
    ten times the largest absolute training value are not stable either."""
    y = np.asarray(values, dtype=float)
    if steps <= 0:
        return np.array([]), 0, 0
    if np.isnan(y).all():
        return np.full(steps, np.nan), 0, 0
    bound = 10 * np.nanmax(np.abs(y))
    tail = max(1, min(steps, len(y) // 5))
    head, held = y[:len(y) - tail], y[len(y) - tail:]

    def error(fit) -> float:
        out = roll_out(head, fit, tail)
        miss = np.abs(out - held)[~np.isnan(held)]
        return float(np.mean(miss)) if len(miss) and np.nanmax(np.abs(out)) <= bound else np.inf

    ranked = []
    if (~np.isnan(head)).any() and (~np.isnan(held)).any():
        last = error(None)
        for a, b in candidate_orders(p, q):
            fit = fit_arma(np.diff(head), a, b)
            if fit is not None and (e := error(fit)) < last:
                ranked.append((e, a, b))
    for _, a, b in sorted(ranked):
        start = fit_arma(np.diff(y), a, b)
        if start is None:
            continue
        for fit in (refined(np.diff(y), start), start):
            out = roll_out(y, fit, steps)
            if np.abs(out).max() <= bound:
                return out, a, b
    return roll_out(y, None, steps), 0, 0


def forecast_hourly(df: DataFrame, keys=("device_id",), p: int = 20, q: int = 15) -> DataFrame:
    """M8: per key, fit on the train part of the hourly series and forecast every
    test hour. Output (keys, hour, actual, forecast, ar_order, ma_order): the orders
    used, which are at most the wanted ones."""
    keys = list(keys)
    s = chrono_split(hourly_series_filled(df, keys), keys)
    kschema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in s.schema.fields if f.name in keys)
    schema = (kschema + ", " if kschema else "") + "hour bigint, actual double, forecast double, ar_order int, ma_order int"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("hour")
        tr = pdf[pdf["split"] == "train"]
        te = pdf[pdf["split"] == "test"]
        fc, ar, ma = fit_forecast(tr["mean_size"].to_numpy(dtype=float), len(te), p, q)
        out = te[keys + ["hour"]].copy()
        out["actual"] = te["mean_size"].astype(float).to_numpy()
        out["forecast"] = fc
        out["ar_order"], out["ma_order"] = ar, ma
        return out

    g = s.groupBy(*keys) if keys else s.groupBy(F.lit(0).alias("__k"))
    return g.applyInPandas(one, schema)
