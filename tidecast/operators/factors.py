"""Factor imputation, filters and decompositions: kernels run per key in grouped functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import DATE, value_columns
from .kernels import grow_tree, lag_design, ols, principal_components


def bai_ng_rank(z: np.ndarray, most: int, rule: int = 2) -> int:
    """Rank of least ln residual variance plus penalty; zero factors is a candidate."""
    t, n = z.shape
    v, m = [], min(n, t)
    for k in range(min(most, m) + 1):
        f, load = principal_components(z, k) if k else (np.zeros((t, 0)), np.zeros((0, n)))
        s = ((z - f @ load) ** 2).mean()
        pen = {1: k * np.log(n * t / (n + t)) * (n + t) / (n * t), 2: k * (n + t) / (n * t) * np.log(m), 3: k * np.log(m) / m}[rule]
        v.append(np.log(max(s, 1e-300)) + pen)
    return int(np.argmin(v))


def em_impute(x: np.ndarray, n_factors: int = 8, rule: int | None = 2, max_iter: int = 50, tol: float = 1e-6) -> np.ndarray:
    """Fill missing cells by the common component, again and again; empty rows and columns stay missing."""
    hole = ~np.isfinite(x)
    cols, rows = ~hole.all(0), ~hole.all(1)
    z, gap = x[np.ix_(rows, cols)].copy(), hole[np.ix_(rows, cols)]
    if gap.any():
        z = np.where(gap, np.nanmean(z, axis=0), z)
        before = None
        for _ in range(max_iter):
            m, s = z.mean(0), z.std(0, ddof=1)
            s = np.where(s > 0, s, 1)
            w = (z - m) / s
            k = bai_ng_rank(w, n_factors, rule) if rule else min(w.shape) // 2
            f, load = principal_components(w, k) if k else (np.zeros((len(w), 0)), np.zeros((0, w.shape[1])))
            fitted = f @ load
            z = np.where(gap, fitted * s + m, z)
            if before is not None and ((fitted - before) ** 2).sum() <= tol * max((before**2).sum(), 1e-300):
                break
            before = fitted
    out = x.copy()
    out[np.ix_(rows, cols)] = z
    return out


def _per_key(panel: DataFrame, columns: Sequence[str], by: Sequence[str], work: Callable[[np.ndarray], np.ndarray], names: Sequence[str] | None = None) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in panel.schema}
    made = list(names or columns)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in (*by, DATE)), *(f"`{c}` double" for c in made)])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(DATE)
        new = work(pdf[list(columns)].to_numpy(float))
        out = pdf[[*by, DATE]].reset_index(drop=True)
        return out.assign(**{c: new[:, i] for i, c in enumerate(made)})

    rows = panel.select(*by, DATE, *columns)
    # A panel without keys is one small matrix.
    done = rows.groupBy(*by).applyInPandas(one, schema)
    return done.select(*by, DATE, *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in made])


def em_factor_impute(panel: DataFrame, columns: Sequence[str] | None = None, n_factors: int = 8, by: Sequence[str] = (), **o) -> DataFrame:
    return _per_key(panel, value_columns(panel, columns, by), by, lambda x: em_impute(x, n_factors, **o))


def em_multivariate_impute(panel: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = (), max_iter: int = 20, tol: float = 1e-4) -> DataFrame:
    return _per_key(panel, value_columns(panel, columns, by), by, lambda x: em_impute(x, 0, None, max_iter, tol))


def pca_features(panel: DataFrame, columns: Sequence[str] | None = None, n_components: int = 1, fit_policy: str = "expanding", min_train: int = 24, by: Sequence[str] = (), prefix: str = "pc") -> DataFrame:
    """Scores of standardised columns, refitted on each date's past (expanding) or on all rows (full)."""

    def score(z, at):
        m, s = z.mean(0), z.std(0)
        s = np.where(s > 0, s, 1)
        _, v = principal_components((z - m) / s, n_components)
        return (at - m) / s @ v.T

    def work(x):
        out = np.full((len(x), n_components), np.nan)
        ok = np.isfinite(x).all(1)
        if fit_policy == "full":
            out[ok] = score(x[ok], x[ok])
            return out
        for t in range(len(x)):
            past = np.flatnonzero(ok[: t + 1])
            if ok[t] and len(past) >= min_train:
                out[t] = score(x[past], x[t])
        return out

    return _per_key(panel, value_columns(panel, columns, by), by, work, [f"{prefix}{i + 1}" for i in range(n_components)])


def dfm_features(panel: DataFrame, n_factors: int = 3, **o) -> DataFrame:
    return pca_features(panel, n_components=n_factors, fit_policy="full", prefix="dfm", **o)


def maf_features(panel: DataFrame, column: str, max_lag: int = 12, n_components: int = 2, by: Sequence[str] = ()) -> DataFrame:
    """Components of a variable's own lag block."""
    from .features import lag

    made = lag(panel, [column], range(1, max_lag + 1), by)
    return pca_features(made, [f"{column}_lag{k}" for k in range(1, max_lag + 1)], n_components, "full", by=by, prefix=f"{column}_maf")


def varimax(v: np.ndarray, max_iter: int = 50, tol: float = 1e-7) -> np.ndarray:
    r, before = np.eye(v.shape[1]), 0.0
    for _ in range(max_iter):
        w = v @ r
        u, s, t = np.linalg.svd(v.T @ (w**3 - w * (w**2).mean(0)))
        r, now = u @ t, s.sum()
        if now - before < tol * max(now, 1e-300):
            break
        before = now
    return v @ r


def hp_trend(y: np.ndarray, lamb: float = 129600.0) -> np.ndarray:
    d = np.diff(np.eye(len(y)), 2, axis=0)
    return np.linalg.solve(np.eye(len(y)) + lamb * d.T @ d, y)


def hp_filter(panel: DataFrame, column: str, lamb: float = 129600.0, by: Sequence[str] = ()) -> DataFrame:
    """trend and cycle."""

    def work(x):
        out, ok = np.full((len(x), 2), np.nan), np.isfinite(x[:, 0])
        t = hp_trend(x[ok, 0], lamb)
        out[ok] = np.column_stack([t, x[ok, 0] - t])
        return out

    return _per_key(panel, [column], by, work, ["trend", "cycle"])


def hamilton_filter(panel: DataFrame, column: str, h: int = 8, p: int = 4, by: Sequence[str] = ()) -> DataFrame:
    """Residual and fit of y[t + h] on y[t], ..., y[t - p + 1], full sample."""

    def work(x):
        y, out = x[:, 0], np.full((len(x), 2), np.nan)
        at = np.arange(h + p - 1, len(y))
        z = np.column_stack([y[at - h - k] for k in range(p)])
        ok = np.isfinite(z).all(1) & np.isfinite(y[at])
        if ok.sum() > p + 1:
            fit = ols(z[ok], y[at][ok])(z[ok])
            out[at[ok]] = np.column_stack([fit, y[at][ok] - fit])
        return out

    return _per_key(panel, [column], by, work, ["trend", "cycle"])


def stl_additive(y: np.ndarray, period: int = 12, sweeps: int = 3) -> np.ndarray:
    """trend, seasonal, remainder by repeated centred means and season means."""
    season = np.zeros(len(y))
    pos = np.arange(len(y)) % period
    for _ in range(sweeps):
        d = y - season
        pad = np.concatenate([np.full(period, d[:period].mean()), d, np.full(period, d[-period:].mean())])
        trend = np.convolve(pad, np.ones(period) / period, "same")[period : period + len(y)]
        means = np.array([np.mean((y - trend)[pos == k]) for k in range(period)])
        season = (means - means.mean())[pos]
    return np.column_stack([trend, season, y - trend - season])


def stl_decompose(panel: DataFrame, column: str, period: int = 12, by: Sequence[str] = ()) -> DataFrame:
    def work(x):
        out, ok = np.full((len(x), 3), np.nan), np.isfinite(x[:, 0])
        if ok.sum() >= 2 * period:
            out[ok] = stl_additive(x[ok, 0], period)
        return out

    return _per_key(panel, [column], by, work, ["trend", "seasonal", "remainder"])


def albama(panel: DataFrame, column: str, n_estimators: int = 100, min_samples_leaf: int = 6, by: Sequence[str] = (), random_state: int = 0) -> DataFrame:
    """Adaptive moving average: bagged trees of the series on time."""

    def work(x):
        out, ok = np.full((len(x), 1), np.nan), np.flatnonzero(np.isfinite(x[:, 0]))
        y, t, rng = x[ok, 0], ok[:, None].astype(float), np.random.default_rng(random_state)
        total = np.zeros(len(ok))
        for _ in range(n_estimators):
            ids = np.sort(rng.integers(0, len(ok), len(ok)))
            total += grow_tree(t[ids], y[ids], None, min_samples_leaf)(t)
        out[ok, 0] = total / n_estimators
        return out

    return _per_key(panel, [column], by, work, ["smooth"])


def adf_statistic(y: np.ndarray, lags: int = 1) -> float:
    d = np.diff(y)
    x = np.column_stack([np.ones(len(d) - lags), y[lags:-1], *[d[lags - k : len(d) - k] for k in range(1, lags + 1)]])
    t = d[lags:]
    b = np.linalg.lstsq(x, t, rcond=None)[0]
    e = t - x @ b
    return float(b[1] / np.sqrt(e @ e / (len(t) - x.shape[1]) * np.linalg.pinv(x.T @ x)[1, 1]))


def stationarity_tests(long: DataFrame, lags: int = 1) -> DataFrame:
    """series, adf, n: augmented Dickey-Fuller statistic with a constant (5 % critical value -2.86)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values(DATE)["value"].dropna().to_numpy()
        s = adf_statistic(y, lags) if len(y) > lags + 8 and np.ptp(y) > 0 else np.nan
        return pd.DataFrame({"series": [pdf["series"].iloc[0]], "adf": [s], "n": [len(y)]})

    return long.groupBy("series").applyInPandas(one, "series string, adf double, n long")


adf_test = stationarity_tests


def chow_lin(low: np.ndarray, indicator: np.ndarray, rho: float = 0.75, aggregation: str = "mean") -> np.ndarray:
    """Monthly path whose quarterly means (or sums) are ``low``: GLS on the indicator with AR(1) errors."""
    n, m = len(low), len(low) * 3
    c = np.kron(np.eye(n), np.ones(3) / (3 if aggregation == "mean" else 1))
    x = np.column_stack([np.ones(m), indicator[:m]])
    v = rho ** np.abs(np.subtract.outer(np.arange(m), np.arange(m))) / (1 - rho**2)
    cv = np.linalg.inv(c @ v @ c.T)
    cx = c @ x
    b = np.linalg.solve(cx.T @ cv @ cx, cx.T @ cv @ low)
    return x @ b + v @ c.T @ cv @ (low - cx @ b)


def ar_residual_whiteness(y: np.ndarray, p: int) -> np.ndarray:
    x, t = lag_design(y, p)
    return t - ols(x, t)(x)
