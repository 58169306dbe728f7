"""Regression covariances, unit roots, cointegration, causality and volatility kernels in NumPy.

``per_series`` runs a kernel on every series of a long panel as a grouped function.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import log, pi, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions import stats as S
from .kernels import _sig, companion, custom_model, lag_design, nelder_mead, ols, principal_components, var_fit


def per_series(long: DataFrame, kernel: Callable[[np.ndarray], dict[str, float]], names: Sequence[str], key: str = "series", value: str = "value") -> DataFrame:
    """One row per series with the named results; a kernel that fails gives NULLs."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("date")[value].dropna().to_numpy(float)
        try:
            out = kernel(y)
        except (ValueError, np.linalg.LinAlgError, IndexError):
            out = {}
        row = {n: [None if out.get(n) is None or not np.isfinite(out[n]) else float(out[n])] for n in names}
        return pd.DataFrame({key: [pdf[key].iloc[0]], **row, "n": [len(y)]})

    return long.groupBy(key).applyInPandas(one, f"{key} string, " + ", ".join(f"{n} double" for n in names) + ", n long")


# Regression covariances.


def _design(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), x])


def hac_covariance(x: np.ndarray, y: np.ndarray, lags: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (intercept first) and their Bartlett covariance."""
    z = _design(x)
    n = len(z)
    lags = int(4 * (n / 100) ** (2 / 9)) if lags is None else lags
    b = np.linalg.lstsq(z, y, rcond=None)[0]
    u = z * (y - z @ b)[:, None]
    s = u.T @ u
    for k in range(1, lags + 1):
        g = u[k:].T @ u[:-k]
        s += (1 - k / (lags + 1)) * (g + g.T)
    inv = np.linalg.pinv(z.T @ z)
    return b, inv @ s @ inv


newey_west = hac_covariance


def vcov_hc(x: np.ndarray, y: np.ndarray, kind: str = "HC1") -> tuple[np.ndarray, np.ndarray]:
    z = _design(x)
    n, k = z.shape
    b = np.linalg.lstsq(z, y, rcond=None)[0]
    inv = np.linalg.pinv(z.T @ z)
    h = np.einsum("ij,jk,ik->i", z, inv, z)
    e2 = (y - z @ b) ** 2
    w = {"HC0": e2, "HC1": e2 * n / (n - k), "HC2": e2 / (1 - h), "HC3": e2 / (1 - h) ** 2}[kind]
    return b, inv @ (z.T * w) @ z @ inv


def breusch_pagan(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """n R² of squared residuals on the regressors, and its p-value."""
    e2 = (y - ols(x, y)(x)) ** 2
    r2 = 1 - ((e2 - ols(x, e2)(x)) ** 2).sum() / max(((e2 - e2.mean()) ** 2).sum(), 1e-300)
    return len(y) * r2, S.chi2_sf(len(y) * r2, x.shape[1])


# Unit roots.


def _adf_regression(y: np.ndarray, lags: int, trend: str = "c") -> tuple[float, float, int]:
    """t of the level, residual sum of squares and rows."""
    d = np.diff(y)
    t = d[lags:]
    parts = [y[lags:-1], *[d[lags - k : len(d) - k] for k in range(1, lags + 1)]]
    if trend in ("c", "ct"):
        parts.append(np.ones(len(t)))
    if trend == "ct":
        parts.append(np.arange(len(t), dtype=float))
    x = np.column_stack(parts)
    b = np.linalg.lstsq(x, t, rcond=None)[0]
    e = t - x @ b
    return float(b[0] / sqrt(max(e @ e / (len(t) - x.shape[1]) * np.linalg.pinv(x.T @ x)[0, 0], 1e-300))), float(e @ e), len(t)


def adf(y: np.ndarray, max_lag: int | None = None, trend: str = "c") -> dict[str, float]:
    """Statistic at the lag of least AIC over a common sample."""
    top = int(12 * (len(y) / 100) ** 0.25) if max_lag is None else max_lag
    top = max(0, min(top, len(y) // 3 - 3))

    def aic(p):
        _, rss, n = _adf_regression(y[top - p :], p, trend)
        return n * log(max(rss / n, 1e-300)) + 2 * (p + 2)

    p = min(range(top + 1), key=aic)
    return {"statistic": _adf_regression(y, p, trend)[0], "lags": p}


def _long_run(e: np.ndarray, lags: int) -> float:
    n = len(e)
    return float(e @ e / n + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) / n for k in range(1, lags + 1)))


def phillips_perron(y: np.ndarray) -> dict[str, float]:
    """Z-tau with a constant."""
    x, t = _design(y[:-1]), y[1:]
    b = np.linalg.lstsq(x, t, rcond=None)[0]
    e = t - x @ b
    n = len(t)
    lags = int(4 * (n / 100) ** 0.25)
    g0, lam = e @ e / n, _long_run(e, lags)
    se = sqrt(e @ e / (n - 2) * np.linalg.inv(x.T @ x)[1, 1])
    tau = (b[1] - 1) / se
    return {"statistic": sqrt(g0 / lam) * tau - (lam - g0) / (2 * sqrt(lam)) * n * se / sqrt(e @ e / (n - 2)), "lags": lags}


def kpss(y: np.ndarray, trend: str = "c") -> dict[str, float]:
    n = len(y)
    e = y - y.mean() if trend == "c" else y - ols(np.arange(n, dtype=float)[:, None], y)(np.arange(n, dtype=float)[:, None])
    lags = int(4 * (n / 100) ** 0.25)
    return {"statistic": float((np.cumsum(e) ** 2).sum() / n**2 / max(_long_run(e, lags), 1e-300)), "lags": lags}


def dfgls(y: np.ndarray) -> dict[str, float]:
    """ADF without terms on the series after local-to-unity detrending by a constant."""
    a = 1 - 7 / len(y)
    yq, zq = np.append(y[0], y[1:] - a * y[:-1]), np.append(1.0, np.full(len(y) - 1, 1 - a))
    return adf(y - (zq @ yq) / (zq @ zq), trend="n")


def zivot_andrews(y: np.ndarray, trim: float = 0.15, lags: int = 1) -> dict[str, float]:
    """Least ADF t over breaks in the level."""
    d, n = np.diff(y), len(y)
    t = d[lags:]
    base = [y[lags:-1], *[d[lags - k : len(d) - k] for k in range(1, lags + 1)], np.ones(len(t)), np.arange(len(t), dtype=float)]
    best = (np.inf, 0)
    for at in range(int(trim * n), int((1 - trim) * n)):
        x = np.column_stack([*base, (np.arange(lags + 1, n) > at).astype(float)])
        b = np.linalg.lstsq(x, t, rcond=None)[0]
        e = t - x @ b
        best = min(best, (float(b[0] / sqrt(e @ e / (len(t) - x.shape[1]) * np.linalg.pinv(x.T @ x)[0, 0])), at))
    return {"statistic": best[0], "break_position": best[1]}


#: 5 % critical values, KPSS level, ADF constant.
KPSS_5, ADF_5 = 0.463, -2.86


def ndiffs(y: np.ndarray, max_d: int = 2) -> dict[str, float]:
    d = 0
    while d < max_d and np.ptp(y) > 0 and kpss(y)["statistic"] > KPSS_5:
        y, d = np.diff(y), d + 1
    return {"ndiffs": d}


def nsdiffs(y: np.ndarray, m: int = 12, threshold: float = 0.64) -> dict[str, float]:
    """One seasonal difference if seasonal strength is above the threshold."""
    from .factors import stl_additive

    _, s, r = stl_additive(y, m).T
    return {"nsdiffs": float(max(0, 1 - r.var() / max((s + r).var(), 1e-300)) > threshold)}


def pacf(y: np.ndarray, nlags: int = 10) -> np.ndarray:
    """Durbin-Levinson on the biased autocorrelations."""
    e = y - y.mean()
    r = np.array([e[k:] @ e[: len(e) - k] / (e @ e) for k in range(nlags + 1)])
    phi, out = np.zeros(0), [1.0]
    for k in range(1, nlags + 1):
        a = (r[k] - phi @ r[k - 1 : 0 : -1]) / (1 - phi @ r[1:k]) if k > 1 else r[1]
        phi = np.append(phi - a * phi[::-1], a)
        out.append(float(a))
    return np.array(out)


# Cointegration and causality.


def engle_granger(y: np.ndarray, x: np.ndarray) -> dict[str, float]:
    return adf(y - ols(x, y)(x), trend="n")


def phillips_ouliaris(y: np.ndarray, x: np.ndarray) -> dict[str, float]:
    return phillips_perron(y - ols(x, y)(x))


def johansen(z: np.ndarray, k_ar_diff: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Trace and maximum-eigenvalue statistics for rank 0, 1, ... (constant outside)."""
    d = np.diff(z, axis=0)
    t = len(d) - k_ar_diff
    lagged = np.column_stack([np.ones(t), *[d[k_ar_diff - j : len(d) - j] for j in range(1, k_ar_diff + 1)]])
    clean = lambda a: a - lagged @ np.linalg.lstsq(lagged, a, rcond=None)[0]
    r0, r1 = clean(d[k_ar_diff:]), clean(z[k_ar_diff:-1])
    s00, s11, s01 = r0.T @ r0 / t, r1.T @ r1 / t, r0.T @ r1 / t
    ev = np.sort(np.linalg.eigvals(np.linalg.solve(s11, s01.T) @ np.linalg.solve(s00, s01)).real)[::-1]
    ev = np.clip(ev, 0, 1 - 1e-12)
    return np.array([-t * np.log(1 - ev[r:]).sum() for r in range(len(ev))]), -t * np.log(1 - ev)


def granger_causality(z: np.ndarray, caused: int, causing: Sequence[int], n_lag: int = 1) -> tuple[float, float]:
    """F statistic and p-value of the lags of ``causing`` in the equation of ``caused``."""
    n, k = z.shape
    x = np.column_stack([z[n_lag - j : n - j] for j in range(1, n_lag + 1)])
    y = z[n_lag:, caused]
    out = [j * k + i for j in range(n_lag) for i in causing]
    keep = [c for c in range(x.shape[1]) if c not in out]
    full, small = ((y - ols(v, y)(v)) @ (y - ols(v, y)(v)) for v in (x, x[:, keep]))
    d2 = len(y) - x.shape[1] - 1
    f = (small - full) / len(out) / (full / d2)
    return float(f), S.f_sf(float(f), len(out), d2)


def instantaneous_causality(z: np.ndarray, a: int, b: int, n_lag: int = 1) -> tuple[float, float]:
    """Wald statistic of zero residual correlation."""
    c, m = var_fit(z, n_lag)
    e = z[n_lag:] - c - np.column_stack([z[n_lag - j : len(z) - j] for j in range(1, n_lag + 1)]) @ m.T
    r = np.corrcoef(e[:, a], e[:, b])[0, 1]
    w = len(e) * r * r / (1 + r * r)
    return float(w), S.chi2_sf(float(w), 1)


def var_select_order(z: np.ndarray, max_lag: int = 6) -> dict[str, int]:
    """Order of least aic, hq, bic, fpe on a common sample."""
    n, k, table = len(z) - max_lag, z.shape[1], {}
    for p in range(1, max_lag + 1):
        zz = z[max_lag - p :]
        c, m = var_fit(zz, p)
        e = zz[p:] - c - np.column_stack([zz[p - j : len(zz) - j] for j in range(1, p + 1)]) @ m.T
        ld, free = float(np.linalg.slogdet(e.T @ e / n)[1]), p * k * k + k
        table[p] = {"aic": ld + 2 * free / n, "hq": ld + 2 * np.log(np.log(n)) * free / n, "bic": ld + np.log(n) * free / n, "fpe": k * np.log((n + p * k + 1) / (n - p * k - 1)) + ld}
    return {c: min(table, key=lambda p: table[p][c]) for c in ("aic", "hq", "bic", "fpe")}


def generalized_irf(z: np.ndarray, n_lag: int = 1, periods: int = 10) -> np.ndarray:
    c, m = var_fit(z, n_lag)
    k = z.shape[1]
    e = z[n_lag:] - c - np.column_stack([z[n_lag - j : len(z) - j] for j in range(1, n_lag + 1)]) @ m.T
    s = e.T @ e / (len(e) - k * n_lag - 1)
    a, power, out = companion(m, k, n_lag), np.eye(k * n_lag), []
    for _ in range(periods + 1):
        out.append(power[:k, :k] @ s / np.sqrt(np.diag(s)))
        power = power @ a
    return np.array(out)


def favar_forecast(z: np.ndarray, target: int, h: int, n_factors: int = 2, n_lag: int = 2) -> np.ndarray:
    """Factors of the other columns and the target in one vector autoregression."""
    others = np.delete(z, target, 1)
    s = others.std(0)
    f, _ = principal_components((others - others.mean(0)) / np.where(s > 0, s, 1), n_factors)
    from .kernels import var_forecast

    return var_forecast(np.column_stack([z[:, target], f]), h, n_lag)[:, 0]


# Densities and value at risk.


def berkowitz(pit: np.ndarray) -> tuple[float, float]:
    """Likelihood ratio of mean 0, variance 1 and no first-order dependence of the normal scores."""
    z = np.array([S.norm_ppf(min(max(float(p), 1e-9), 1 - 1e-9)) for p in pit])
    x, y = z[:-1, None], z[1:]
    e = y - ols(x, y)(x)
    v = e @ e / len(e)
    free, null = -0.5 * len(y) * (log(2 * pi * v) + 1), -0.5 * (len(y) * log(2 * pi) + y @ y)
    lr = 2 * (free - null)
    return float(lr), S.chi2_sf(float(lr), 3)


def dynamic_quantile(y: np.ndarray, var: np.ndarray, alpha: float = 0.05, lags: int = 1) -> tuple[float, float]:
    """Engle-Manganelli: hits on a constant, their lags and the value at risk."""
    hit = (y < var).astype(float) - alpha
    x = np.column_stack([np.ones(len(hit) - lags), *[hit[lags - k : len(hit) - k] for k in range(1, lags + 1)], var[lags:]])
    h = hit[lags:]
    stat = float(h @ x @ np.linalg.pinv(x.T @ x) @ x.T @ h / (alpha * (1 - alpha)))
    return stat, S.chi2_sf(stat, x.shape[1])


def giacomini_white(d: np.ndarray, instruments: np.ndarray, lag: int = 1) -> tuple[float, float]:
    """Wald test that the loss difference cannot be predicted by lagged instruments."""
    z = instruments[:-lag] * d[lag:, None]
    m = z.mean(0)
    w = float(len(z) * m @ np.linalg.pinv(z.T @ z / len(z)) @ m)
    return w, S.chi2_sf(w, z.shape[1])


def multi_horizon_spa(d: np.ndarray, statistic: str = "uspa", n_boot: int = 499, block: int = 3, seed: int = 0) -> tuple[float, float]:
    """uspa: least t over horizons; aspa: t of the mean over horizons (``d``: benchmark loss less model loss)."""
    from .tests_stat import _block_ids

    rng, n = np.random.default_rng(seed), len(d)
    x = d if statistic == "uspa" else d.mean(1, keepdims=True)
    m = x.mean(0)
    boot = np.array([x[_block_ids(n, block, rng)].mean(0) - m for _ in range(n_boot)])
    s = np.maximum(boot.std(0), 1e-300)
    t = float((m / s).min())
    return t, float(((boot / s).min(1) >= t).mean())


def romano_wolf(d: np.ndarray, n_boot: int = 999, block: int = 3, seed: int = 0) -> np.ndarray:
    """Step-down p-values of the mean of each column of ``d`` being zero."""
    from .tests_stat import _block_ids

    rng, n = np.random.default_rng(seed), len(d)
    m = d.mean(0)
    boot = np.array([d[_block_ids(n, block, rng)].mean(0) - m for _ in range(n_boot)])
    s = np.maximum(boot.std(0), 1e-300)
    t, tb = np.abs(m / s), np.abs(boot / s)
    order, p, top = np.argsort(-t), np.empty(len(t)), 0.0
    for i, j in enumerate(order):
        top = max(top, float((1 + (tb[:, order[i:]].max(1) >= t[j]).sum()) / (n_boot + 1)))
        p[j] = top
    return p


# Volatility.


def egarch_path(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(omega, alpha, gamma, beta) of EGARCH(1,1) by Gaussian quasi-likelihood, and log variances with the next one."""
    e = y - y.mean()
    start = log(max(e.var(), 1e-12))

    def path(p):
        b = 0.98 * _sig(p[3])
        h = np.empty(len(e) + 1)
        h[0] = start
        for t in range(len(e)):
            z = e[t] / np.exp(h[t] / 2)
            h[t + 1] = np.clip((1 - b) * (start + p[0]) + b * h[t] + p[1] * (abs(z) - sqrt(2 / pi)) + p[2] * z, -50, 50)
        return h

    def nll(p):
        h = path(p)[:-1]
        return float(h.sum() + (e**2 / np.exp(h)).sum())

    p = nelder_mead(nll, np.array([0.0, 0.1, 0.0, 2.0]), 250, 0.3)
    return p, path(p)


def risk_forecast(mean: float, variance: np.ndarray, alpha: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian value at risk and expected shortfall of the lower tail, as losses."""
    q = S.norm_ppf(alpha)
    s = np.sqrt(variance)
    return -(mean + q * s), -(mean - s * float(S.norm_pdf(q)) / alpha)


def news_impact_curve(omega: float, alpha: float, beta: float, variance: float, gamma: float = 0.0, span: float = 3.0, n: int = 101) -> tuple[np.ndarray, np.ndarray]:
    e = np.linspace(-span, span, n) * sqrt(variance)
    return e, omega + (alpha + gamma * (e < 0)) * e**2 + beta * variance


def garch_roll(y: np.ndarray, first: int, alpha: float = 0.05, refit: int = 25) -> pd.DataFrame:
    """One-step value at risk from ``first`` on, refitted every ``refit`` rows, with hits."""
    from .kernels import garch_variance

    out = []
    for start in range(first, len(y), refit):
        for t in range(start, min(start + refit, len(y))):
            v = garch_variance(y[:t], 1)[0] if t == start else 0.06 * (y[t - 1] - y[:t].mean()) ** 2 + 0.94 * v
            var, _ = risk_forecast(y[:t].mean(), np.array([v]), alpha)
            out.append((t, float(v), float(var[0]), bool(y[t] < -var[0])))
    return pd.DataFrame(out, columns=["pos", "variance", "value_at_risk", "hit"])


# Unobserved components with stochastic volatility, by Gibbs sampling with a mixture approximation.

#: Weights, means and variances of the seven-normal approximation of log chi-square(1).
_MIX = np.array([
    [0.00730, -10.12999, 5.79596], [0.10556, -3.97281, 2.61369], [0.00002, -8.56686, 5.17950], [0.04395, 2.77786, 0.16735],
    [0.34001, 0.61942, 0.64009], [0.24566, 1.79518, 0.34023], [0.25750, -1.08819, 1.26261],
])


def _draw_walk(y: np.ndarray, noise: np.ndarray, step: np.ndarray, rng: np.random.Generator, wide: float = 100.0) -> np.ndarray:
    """A draw of a random walk seen with noise: forward filter, backward sample."""
    n = len(y)
    m, p = np.empty(n), np.empty(n)
    a, v = y[0], wide
    for t in range(n):
        k = v / (v + noise[t])
        m[t], p[t] = a + k * (y[t] - a), (1 - k) * v
        a, v = m[t], p[t] + step[min(t + 1, n - 1)]
    x = np.empty(n)
    x[-1] = rng.normal(m[-1], sqrt(p[-1]))
    for t in range(n - 2, -1, -1):
        g = p[t] / (p[t] + step[t + 1])
        x[t] = rng.normal(m[t] + g * (x[t + 1] - m[t]), sqrt(max(p[t] * (1 - g), 1e-12)))
    return x


def _draw_log_vol(e: np.ndarray, h: np.ndarray, gamma: float, rng: np.random.Generator) -> np.ndarray:
    s = np.log(e**2 + 1e-8)
    w = _MIX[:, 0] * np.exp(-0.5 * (s[:, None] - h[:, None] - _MIX[:, 1] + 1.2704) ** 2 / _MIX[:, 2]) / np.sqrt(_MIX[:, 2])
    w = np.cumsum(w + 1e-300, axis=1)
    k = (rng.random(len(s))[:, None] * w[:, -1:] > w).sum(1)
    return _draw_walk(s - _MIX[k, 1] + 1.2704, _MIX[k, 2], np.full(len(s), gamma), rng, 10.0)


def ucsv(y: np.ndarray, n_draws: int = 600, burn: int = 200, gamma: float = 0.2, seed: int = 0) -> np.ndarray:
    """Posterior mean of the trend; its last value is the forecast at every horizon."""
    rng = np.random.default_rng(seed)
    base = log(max(np.diff(y).var() / 2, 1e-8))
    h, g, total = np.full(len(y), base), np.full(len(y), base), np.zeros(len(y))
    for i in range(n_draws):
        x = _draw_walk(y, np.exp(h), np.exp(g), rng)
        h = np.clip(_draw_log_vol(y - x, h, gamma, rng), base - 12, base + 12)
        g = np.clip(_draw_log_vol(np.append(np.diff(x)[0], np.diff(x)), g, gamma, rng), base - 12, base + 12)
        if i >= burn:
            total += x / (n_draws - burn)
    return total


def bvar_niw_forecast(z: np.ndarray, h: int, n_lag: int = 1, scale: float = 10.0) -> np.ndarray:
    """Posterior-mean forecast under a normal-inverse-Wishart prior centred on zero."""
    x = np.column_stack([np.ones(len(z) - n_lag), *[z[n_lag - j : len(z) - j] for j in range(1, n_lag + 1)]])
    b = np.linalg.solve(x.T @ x + np.eye(x.shape[1]) / scale, x.T @ z[n_lag:])
    path = list(z)
    for _ in range(h):
        path.append(np.concatenate([[1.0], *path[: -n_lag - 1 : -1]]) @ b)
    return np.array(path[len(z) :])


def star_forecast(y: np.ndarray, h: int, n_lag: int = 2) -> np.ndarray:
    """Logistic smooth transition between two autoregressions in the first lag."""
    x, t = lag_design(y, n_lag)
    s = max(x[:, 0].std(), 1e-12)

    def design(v, p):
        g = _sig(np.exp(np.clip(p[0], -5, 5)) * (v[:, 0] - p[1]) / s)[:, None]
        z = np.column_stack([np.ones(len(v)), v])
        return np.column_stack([z, g * z])

    def sse(p):
        z = design(x, p)
        return float(((t - z @ np.linalg.lstsq(z, t, rcond=None)[0]) ** 2).sum())

    p = nelder_mead(sse, np.array([0.0, float(np.median(x[:, 0]))]), 100, 0.5 * s)
    b, path = np.linalg.lstsq(design(x, p), t, rcond=None)[0], list(y)
    for _ in range(h):
        path.append(float((design(np.array(path[: -n_lag - 1 : -1])[None], p) @ b)[0]))
    return np.array(path[len(y) :])


def auto_arima(y: np.ndarray, h: int, max_p: int = 2, max_q: int = 1) -> np.ndarray:
    """Differences by KPSS, orders by AICc of the conditional sum of squares of an autoregression, then ARIMA."""
    from .kernels import s_arima, select_ar_order

    d = int(ndiffs(y, 1)["ndiffs"])
    z = np.diff(y, d) if d else y
    return s_arima(y, h, (min(max_p, select_ar_order(z, max(max_p, 1), "aicc")), d, max_q))


def stlf(y: np.ndarray, h: int, period: int = 12) -> np.ndarray:
    """Seasonally adjusted, smoothed, and put back."""
    from .factors import stl_additive
    from .kernels import s_holt_winters

    if len(y) < 2 * period:
        return s_holt_winters(y, h)
    _, s, _ = stl_additive(y, period).T
    return s_holt_winters(y - s, h, None) + np.array([s[len(y) - period + i % period] for i in range(h)])


for _name, _fit, _kind in (
    ("star", star_forecast, "target"), ("auto_arima", auto_arima, "target"), ("stlf", stlf, "target"),
    ("ucsv", lambda y, h, **o: np.full(h, ucsv(y, **o)[-1]), "target"), ("bvar_normal_inverse_wishart", bvar_niw_forecast, "panel"),
    ("favar", lambda z, h, **o: favar_forecast(z, 0, h, **o), "panel"),
):
    custom_model(_name, _fit, _kind)
