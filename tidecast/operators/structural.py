"""State-space factor models of mixed frequency, restricted vector autoregressions, realised and threshold volatility.

The kernels run inside grouped functions, one panel or series at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import exp, log, sqrt

import numpy as np

from .combine import _simplex
from .kernels import MODELS, ModelSpec, _sig, nelder_mead, ols, ridge, var_fit

# Weights with which a quarter's growth is made of the last five months'.
QUARTER = np.array([1, 2, 3, 2, 1]) / 3.0


def kalman_smoother(z: np.ndarray, c: np.ndarray, a: np.ndarray, q: np.ndarray, noise: np.ndarray, mean: np.ndarray, cov: np.ndarray):
    """Smoothed means, covariances, covariances with the step before, and the likelihood; missing values are NaN."""
    n, k = len(z), a.shape[0]
    m_f, p_f, m_p, p_p, loglik = np.empty((n, k)), np.empty((n, k, k)), np.empty((n, k)), np.empty((n, k, k)), 0.0
    m, p = mean, cov
    for t in range(n):
        if t:
            m, p = a @ m, a @ p @ a.T + q
        m_p[t], p_p[t] = m, p
        seen = np.isfinite(z[t])
        if seen.any():
            h = c[seen]
            s = h @ p @ h.T + np.diag(noise[seen])
            gain = np.linalg.solve(s, h @ p).T
            e = z[t, seen] - h @ m
            loglik -= 0.5 * (np.linalg.slogdet(s)[1] + e @ np.linalg.solve(s, e) + seen.sum() * log(2 * np.pi))
            m, p = m + gain @ e, p - gain @ h @ p
            p = (p + p.T) / 2
        m_f[t], p_f[t] = m, p
    m_s, p_s, cross = m_f.copy(), p_f.copy(), np.zeros((n, k, k))
    for t in range(n - 2, -1, -1):
        g = np.linalg.lstsq(p_p[t + 1], a @ p_f[t], rcond=None)[0].T
        m_s[t] = m_f[t] + g @ (m_s[t + 1] - m_p[t + 1])
        p_s[t] = p_f[t] + g @ (p_s[t + 1] - p_p[t + 1]) @ g.T
        cross[t + 1] = p_s[t + 1] @ g.T
    return m_s, p_s, cross, loglik


class MixedFactorModel:
    """Monthly and quarterly series on common factors; every series has an autoregressive rest of its own.

    The state is five steps of the factors, the rests of the monthly series and
    five steps of the rests of the quarterly ones.  Estimated by EM.
    """

    def __init__(self, panel: np.ndarray, quarterly: Sequence[int] = (), n_factors: int = 1, factor_order: int = 1, idiosyncratic_ar1: bool = True, maxiter: int = 50, tolerance: float = 1e-6):
        if factor_order > 5:
            raise ValueError("at most five factor lags")
        self.mean, s = np.nanmean(panel, 0), np.nanstd(panel, 0)
        self.scale = np.where(s > 0, s, 1.0)
        z = (panel - self.mean) / self.scale
        n, k = z.shape
        self.r, self.order, self.z = n_factors, factor_order, z
        self.slow = np.isin(np.arange(k), list(quarterly))
        self.m, self.q = np.flatnonzero(~self.slow), np.flatnonzero(self.slow)
        filled = np.where(np.isfinite(z), z, 0.0)
        u, d, v = np.linalg.svd(filled[:, self.m] if len(self.m) else filled, full_matrices=False)
        f = u[:, :n_factors] * sqrt(n)
        self.load = np.zeros((k, n_factors))
        for i in range(k):
            ok = np.isfinite(z[:, i])
            self.load[i] = np.linalg.lstsq(f[ok], z[ok, i], rcond=None)[0] if ok.sum() > n_factors else 0.0
        self.load[self.q] /= QUARTER.sum()
        self.trans, self.shock = np.zeros((n_factors, 5 * n_factors)), np.eye(n_factors)
        self.trans[:, : n_factors * factor_order] = var_fit(f, factor_order)[1]
        self.rho, self.var = np.full(k, 0.3 if idiosyncratic_ar1 else 0.0), np.full(k, 0.5)
        self.ar1, self.trace = idiosyncratic_ar1, []
        for _ in range(maxiter):
            self._em_step()
            if len(self.trace) > 1 and abs(self.trace[-1] - self.trace[-2]) < tolerance * (1 + abs(self.trace[-2])):
                break
        self.states = self._smooth()

    def _system(self):
        r, nm, nq = self.r, len(self.m), len(self.q)
        size = 5 * r + nm + 5 * nq
        a, q, c = np.zeros((size, size)), np.zeros((size, size)), np.zeros((len(self.load), size))
        a[:r, : 5 * r], q[:r, :r] = self.trans, self.shock
        a[r : 5 * r, : 4 * r] = np.eye(4 * r)
        for j, i in enumerate(self.m):
            at = 5 * r + j
            a[at, at], q[at, at], c[i, :r], c[i, at] = self.rho[i], self.var[i], self.load[i], 1.0
        for j, i in enumerate(self.q):
            at = 5 * r + nm + 5 * j
            a[at, at], q[at, at] = self.rho[i], self.var[i]
            a[at + 1 : at + 5, at : at + 4] = np.eye(4)
            c[i, : 5 * r], c[i, at : at + 5] = np.kron(QUARTER, self.load[i]), QUARTER
        return a, q, c

    def _smooth(self):
        a, q, c = self._system()
        return kalman_smoother(self.z, c, a, q, np.full(len(c), 1e-4), np.zeros(len(a)), 10 * np.eye(len(a)))

    def _em_step(self) -> None:
        mean, cov, cross, loglik = self._smooth()
        self.trace.append(loglik)
        r, nm, n = self.r, len(self.m), len(self.z)
        second = lambda i, j: np.einsum("ti,tj->tij", mean[:, i], mean[:, j]) + cov[:, i][:, :, j]
        p = self.order * r
        now, past = np.arange(r), np.arange(p)
        lagged = (np.einsum("ti,tj->tij", mean[1:, now], mean[:-1, past]) + cross[1:, now][:, :, past]).sum(0)
        base = second(past, past)[:-1].sum(0)
        self.trans[:, :p] = np.linalg.solve(base + 1e-8 * np.eye(p), lagged.T).T
        self.shock = (second(now, now)[1:].sum(0) - self.trans[:, :p] @ lagged.T) / (n - 1)
        self.shock = (self.shock + self.shock.T) / 2 + 1e-8 * np.eye(r)
        for j, i in enumerate([*self.m, *self.q]):
            slow, ok = self.slow[i], np.isfinite(self.z[:, i])
            at = 5 * r + nm + 5 * (j - nm) if slow else 5 * r + j
            pick = np.kron(QUARTER, np.eye(r)) if slow else np.hstack([np.eye(r), np.zeros((r, 4 * r))])
            own = np.arange(at, at + 5) if slow else np.array([at])
            w = QUARTER if slow else np.ones(1)
            f5 = np.arange(5 * r)
            gg = np.einsum("ab,tbc,dc->tad", pick, second(f5, f5), pick)[ok].sum(0)
            ge = np.einsum("ab,tbc,c->ta", pick, second(f5, own), w)[ok].sum(0)
            yg = (self.z[ok, i, None] * (mean[:, f5] @ pick.T)[ok]).sum(0)
            self.load[i] = np.linalg.solve(gg + 1e-8 * np.eye(r), yg - ge)
            e = np.array([at])
            c0 = second(e, e)[:, 0, 0]
            c1 = (mean[1:, at] * mean[:-1, at] + cross[1:, at, at]).sum()
            self.rho[i] = float(np.clip(c1 / max(c0[:-1].sum(), 1e-12), -0.99, 0.99)) if self.ar1 else 0.0
            self.var[i] = max(float((c0[1:].sum() - self.rho[i] * c1) / (n - 1)), 1e-6)

    @property
    def factors(self) -> np.ndarray:
        return self.states[0][:, : self.r]

    def idiosyncratic(self) -> np.ndarray:
        """Rests of the monthly series, standardised."""
        return self.states[0][:, 5 * self.r : 5 * self.r + len(self.m)]

    def forecast(self, h: int) -> np.ndarray:
        """h rows of all series; a quarterly one as if its quarter ended in that month."""
        a, _, c = self._system()
        m, out = self.states[0][-1], []
        for _ in range(h):
            m = a @ m
            out.append(c @ m)
        return np.array(out) * self.scale + self.mean


def dfm_mixed_mariano_murasawa(panel: np.ndarray, h: int = 1, quarterly: Sequence[int] = (), **options) -> np.ndarray:
    return MixedFactorModel(panel, quarterly, **options).forecast(h)


def dfm_unrestricted_midas(panel: np.ndarray, target: int, quarterly: Sequence[int] = (), lag_columns: Sequence[int] = (), lags: Sequence[int] = (0, 1, 2), factor_lags: Sequence[int] = (0,), alpha: float = 0.0, **options):
    """Least squares (or ridge) of a low-frequency target on lags of the factors and of chosen columns; predictor of design rows."""
    others = [i for i in range(panel.shape[1]) if i != target]
    slow = [others.index(i) for i in quarterly if i != target]
    f = MixedFactorModel(panel[:, others], slow, **options).factors
    shift = lambda v, k: np.concatenate([np.full((k, v.shape[1]), np.nan), v[: len(v) - k]])
    blocks = [shift(f, k) for k in factor_lags] + [shift(panel[:, list(lag_columns)], k) for k in lags if lag_columns]
    x, y = np.hstack(blocks), panel[:, target]
    ok = np.isfinite(x).all(1) & np.isfinite(y)
    predict = ridge(x[ok], y[ok], alpha) if alpha else ols(x[ok], y[ok])
    predict.design, predict.rows = x, np.flatnonzero(ok)
    return predict


# Vector autoregressions.


def var_restrict(z: np.ndarray, n_lag: int = 1, threshold: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (equation x [constant, lags]) and t values after dropping, one by one, what is below ``threshold``."""
    x = np.column_stack([np.ones(len(z) - n_lag), *[z[n_lag - j : len(z) - j] for j in range(1, n_lag + 1)]])
    y, coef, t_values = z[n_lag:], np.zeros((z.shape[1], x.shape[1])), np.zeros((z.shape[1], x.shape[1]))
    for i in range(z.shape[1]):
        keep = list(range(x.shape[1]))
        while True:
            d = x[:, keep]
            b = np.linalg.lstsq(d, y[:, i], rcond=None)[0]
            e = y[:, i] - d @ b
            se = np.sqrt(np.maximum(np.diag(np.linalg.pinv(d.T @ d)) * (e @ e) / max(len(d) - len(keep), 1), 0))
            t = np.divide(b, se, out=np.full_like(b, np.inf), where=se > 0)
            worst = int(np.argmin(np.abs(t)))
            if len(keep) == 1 or abs(t[worst]) >= threshold:
                break
            keep.pop(worst)
        coef[i, keep], t_values[i, keep] = b, t
    return coef, t_values


def var_restricted_forecast(z: np.ndarray, h: int, n_lag: int = 1, threshold: float = 2.0) -> np.ndarray:
    b, path = var_restrict(z, n_lag, threshold)[0], list(z)
    for _ in range(h):
        path.append(b @ np.concatenate([[1.0], *path[: -n_lag - 1 : -1]]))
    return np.array(path[len(z) :])


def historical_decomposition(z: np.ndarray, n_lag: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(row, response, shock) contributions of orthogonal shocks, and the part of the start and the constants."""
    a, b = var_fit(z, n_lag)
    k, n = z.shape[1], len(z) - n_lag
    x = np.column_stack([z[n_lag - j : len(z) - j] for j in range(1, n_lag + 1)])
    e = z[n_lag:] - a - x @ b.T
    root = np.linalg.cholesky(e.T @ e / max(n - k * n_lag - 1, 1))
    shocks = np.linalg.solve(root, e.T).T
    parts, base = np.zeros((n + n_lag, k, k)), z.copy()
    for t in range(n):
        past = [parts[t + n_lag - j] for j in range(1, n_lag + 1)]
        parts[t + n_lag] = sum(b[:, (j - 1) * k : j * k] @ past[j - 1] for j in range(1, n_lag + 1)) + root * shocks[t]
        base[t + n_lag] = a + b @ np.concatenate([base[t + n_lag - j] for j in range(1, n_lag + 1)])
    return parts[n_lag:], base[n_lag:]


def var_residuals(z: np.ndarray, n_lag: int) -> np.ndarray:
    a, b = var_fit(z, n_lag)
    return z[n_lag:] - a - np.column_stack([z[n_lag - j : len(z) - j] for j in range(1, n_lag + 1)]) @ b.T


def var_serial_test(z: np.ndarray, n_lag: int = 1, test_lags: int | None = None, adjusted: bool = False) -> dict[str, float]:
    """Portmanteau test of no autocorrelation in the residuals."""
    from ..functions.stats import chi2_sf

    e = var_residuals(z, n_lag)
    n, k = e.shape
    e = e - e.mean(0)
    lags = test_lags or max(n_lag + 1, 12)
    inv, stat = np.linalg.inv(e.T @ e / n), 0.0
    for i in range(1, lags + 1):
        c = e[i:].T @ e[:-i] / n
        stat += np.trace(c.T @ inv @ c @ inv) / (n - i if adjusted else 1)
    stat *= n**2 if adjusted else n
    df = k * k * (lags - n_lag)
    return {"statistic": float(stat), "p_value": chi2_sf(stat, df), "df": df}


def var_normality_test(z: np.ndarray, n_lag: int = 1) -> dict[str, float]:
    """Skewness and kurtosis of the residuals made orthogonal by the Cholesky root."""
    from ..functions.stats import chi2_sf

    e = var_residuals(z, n_lag)
    n, k = e.shape
    e = e - e.mean(0)
    w = np.linalg.solve(np.linalg.cholesky(e.T @ e / n), e.T)
    skew, kurt = (w**3).mean(1), (w**4).mean(1) - 3
    stat = float(n * (skew @ skew) / 6 + n * (kurt @ kurt) / 24)
    return {"statistic": stat, "p_value": chi2_sf(stat, 2 * k), "df": 2 * k}


def var_arch_test(z: np.ndarray, n_lag: int = 1, arch_lags: int = 5) -> dict[str, float]:
    """Lagrange multiplier test on the products of residuals."""
    from ..functions.stats import chi2_sf

    e = var_residuals(z, n_lag)
    i, j = np.tril_indices(e.shape[1])
    v = e[:, i] * e[:, j]
    y = v[arch_lags:]
    x = np.column_stack([np.ones(len(y)), *[v[arch_lags - s : len(v) - s] for s in range(1, arch_lags + 1)]])
    if len(y) <= x.shape[1]:
        return {"statistic": np.nan, "p_value": np.nan, "df": arch_lags * len(i) ** 2}
    r = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    c = y - y.mean(0)
    fit = 1 - np.trace((r.T @ r) @ np.linalg.pinv(c.T @ c)) / len(i)
    stat, df = float(len(y) * len(i) * fit), arch_lags * len(i) ** 2
    return {"statistic": stat, "p_value": chi2_sf(max(stat, 0.0), df), "df": df}


# Volatility.


def tgarch(y: np.ndarray, h: int = 1) -> np.ndarray:
    """Variance path of the threshold model in standard deviations: s' = w + a |e| + g |e| [e < 0] + b s."""
    e = y - y.mean()
    s0, absolute = max(e.std(), 1e-9), sqrt(2 / np.pi)

    def path(p):
        a, g, b = 0.4 * _sig(p[0]), 0.4 * _sig(p[2]), 0.98 * _sig(p[1])
        keep = max(1 - b - (a + g / 2) * absolute, 1e-4)
        s = np.empty(len(e) + 1)
        s[0] = s0
        for t in range(len(e)):
            s[t + 1] = keep * s0 + (a + g * (e[t] < 0)) * abs(e[t]) + b * s[t]
        return s, b + (a + g / 2) * absolute

    nll = lambda p: float((2 * np.log(path(p)[0][:-1]) + e**2 / path(p)[0][:-1] ** 2).sum())
    s, decay = path(nelder_mead(nll, np.array([-1.0, 1.5, -1.0]), 200, 0.5))
    return (s0 + (s[-1] - s0) * min(decay, 0.9999) ** np.arange(h)) ** 2


def realized_garch(y: np.ndarray, h: int = 1, realized: np.ndarray | None = None, steps: int = 1500) -> np.ndarray:
    """Variance path of the log-linear model with a measurement equation.

    log h = w + a log x' + b log h'; log x = k + d log h + n1 z + n2 (z^2 - 1) + u.
    Without a realised measure the squared return stands in for it.
    """
    x = np.maximum(y**2 if realized is None else np.asarray(realized, float), 1e-12)
    lx, lv = np.log(x), log(max(y.var(), 1e-12))

    def run(p):
        mu, w, a, b, k, d, n1, n2 = p[0], p[1], _sig(p[2]), _sig(p[3]), p[4], exp(np.clip(p[5], -5, 2)), p[6], p[7]
        lh, before, out, u = lv, lv, np.empty(len(y)), np.empty(len(y))
        for t in range(len(y)):
            lh = float(np.clip(w + a * (lx[t - 1] if t else before) + b * lh, -30, 30))
            z = (y[t] - mu) / exp(lh / 2)
            out[t], u[t] = lh, lx[t] - k - d * lh - n1 * z - n2 * (z * z - 1)
        return out, u, (w, a, b, k, d)

    def nll(p):
        lh, u, (_, a, b, _, d) = run(p)
        if b + d * a >= 1:
            return 1e12
        su = exp(np.clip(p[8], -10, 10))
        value = (0.5 * (lh + (y - p[0]) ** 2 / np.exp(lh)) + p[8] + 0.5 * (u / su) ** 2).sum()
        return float(value) if np.isfinite(value) else 1e12

    start = np.array([y.mean(), 0.05 * lv, -2.0, 0.5, lx.mean() - lv, -0.1, 0.0, 0.0, log(max(lx.std(), 1e-3))])
    lh, _, (w, a, b, k, d) = run(nelder_mead(nll, start, steps, 0.2))
    out, now, seen = [], lh[-1], lx[-1]
    for _ in range(h):
        now = w + a * seen + b * now
        seen = k + d * now  # later measurement shocks are zero
        out.append(exp(now))
    return np.array(out)


# Weights on the components of an aggregate.


def _mean_aligned(v: np.ndarray, m: np.ndarray, goal: float) -> np.ndarray:
    """The nearest non-negative weights with m'w = goal: the multiplier lies between two points where a weight leaves zero.

    Without any such weights, the nearest non-negative ones.
    """
    if goal == 0 or not (np.sign(goal) * m > 0).any():
        return np.maximum(v, 0)
    at = lambda t: np.maximum(v + np.multiply.outer(t, m), 0)
    turns = np.sort(-v[m != 0] / m[m != 0])
    turns = np.concatenate([[turns[0] - 1], turns, [turns[-1] + 1]])
    held = at(turns) @ m  # does not fall
    k = int(np.clip(np.searchsorted(held, goal), 1, len(turns) - 1))
    rise = held[k] - held[k - 1]
    return at(turns[k - 1] + (goal - held[k - 1]) / rise * (turns[k] - turns[k - 1]) if rise > 0 else turns[k])


def solve_weights(
    x: np.ndarray, y: np.ndarray, alpha: float = 1.0, penalty: str = "ridge", reference: Sequence[float] | None = None, nonneg: bool = True,
    simplex: bool = False, mean_match: bool = False, difference_order: int = 1, penalty_scale: str = "feature_std", steps: int = 4000,
) -> np.ndarray:
    """Ridge, target-shrinkage or fused-difference weights under the asked constraints, by accelerated projected gradient.

    ``feature_std`` weighs a column's penalty by its standard deviation.
    """
    p = x.shape[1]
    sd = x.std(0, ddof=1) if penalty_scale == "feature_std" and len(x) > 1 else np.ones(p)
    sd = np.where(np.isfinite(sd) & (sd > 0), sd, 1.0)
    ref = np.zeros(p) if penalty == "ridge" else np.full(p, 1 / p) if reference is None else np.asarray(reference, float)
    d = np.diff(np.eye(p), difference_order, axis=0) * sd
    cost = d.T @ d if penalty == "fused_difference" else np.diag(sd)
    g = x.T @ x + alpha * cost
    c = x.T @ y + (alpha * cost @ ref if penalty == "target_shrinkage" else 0)
    if not (nonneg or simplex or mean_match):
        return np.linalg.solve(g + 1e-10 * np.eye(p), c)
    put: Callable = _simplex if simplex else (lambda v: _mean_aligned(v, x.mean(0), float(y.mean()))) if mean_match else (lambda v: np.maximum(v, 0))
    rate = 1 / max(np.linalg.eigvalsh(g)[-1], 1e-12)
    w = z = put(np.full(p, 1 / p))
    t = 1.0
    for _ in range(steps):
        new = put(z - rate * (g @ z - c))
        t_new = (1 + sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t_new * (new - w)
        if np.abs(new - w).max() < 1e-12:
            return new
        w, t = new, t_new
    return w


def solve_nonnegative_ridge(x, y, alpha=1.0, **o):
    return solve_weights(x, y, alpha, **o)


def solve_simplex_ridge(x, y, alpha=1.0, **o):
    return solve_weights(x, y, alpha, simplex=True, **o)


def solve_target_shrinkage_ridge(x, y, reference, alpha=1.0, simplex=True, **o):
    return solve_weights(x, y, alpha, "target_shrinkage", reference, simplex=simplex, **o)


def solve_mean_aligned_ridge(x, y, alpha=1.0, **o):
    return solve_weights(x, y, alpha, mean_match=True, **o)


def solve_fused_difference_ridge(x, y, alpha=1.0, difference_order=1, mean_match=True, **o):
    return solve_weights(x, y, alpha, "fused_difference", difference_order=difference_order, mean_match=mean_match, **o)


def supervised_aggregation(x, y, space="component", penalty="ridge", alpha=1.0, reference_weights=None, nonneg=True, simplex=False, mean_match=False, difference_order=1, fit_intercept=False, penalty_scale="feature_std"):
    """Weights on the columns, or in ``rank`` space on the sorted values of each row."""
    put = (lambda v: np.sort(v, axis=1)) if space == "rank" else (lambda v: v)
    z = put(np.asarray(x, float))
    zm, ym = (z.mean(0), float(y.mean())) if fit_intercept and not (simplex or mean_match) else (0.0, 0.0)
    w = solve_weights(z - zm, y - ym, alpha, penalty, reference_weights, nonneg, simplex, mean_match, difference_order, penalty_scale)
    predict = lambda new: ym + (put(new) - zm) @ w
    predict.weights = w
    return predict


def component_aggregation(x, y, alpha=1.0, reference_weights=None, penalty=None, simplex=True, nonneg=True, penalty_scale="feature_std"):
    """Simplex weights without an intercept: ridge toward zero, or toward reference weights where given."""
    kind = penalty or ("target_shrinkage" if reference_weights is not None else "ridge")
    return supervised_aggregation(x, y, "component", kind, alpha, reference_weights, nonneg, simplex, penalty_scale=penalty_scale)


def rank_aggregation(x, y, alpha=1.0, difference_order=1, mean_match=True, nonneg=True, penalty_scale="feature_std"):
    """Smooth non-negative weights on order statistics, aligned with the target's mean."""
    return supervised_aggregation(x, y, "rank", "fused_difference", alpha, None, nonneg, False, mean_match, difference_order, penalty_scale=penalty_scale)


def assemblage_regression(x, y, space="component", alpha=1.0, reference_weights=None, penalty=None):
    return rank_aggregation(x, y, alpha) if space == "rank" else component_aggregation(x, y, alpha, reference_weights, penalty)


def _register() -> None:
    for name, fit, kind, family in (
        ("supervised_aggregation", supervised_aggregation, "supervised", "aggregation"), ("component_aggregation", component_aggregation, "supervised", "aggregation"),
        ("rank_aggregation", rank_aggregation, "supervised", "aggregation"), ("assemblage_regression", assemblage_regression, "supervised", "aggregation"),
        ("tgarch", tgarch, "volatility", "volatility"), ("realized_garch", realized_garch, "volatility", "volatility"),
        ("var_restricted", var_restricted_forecast, "panel", "vector"), ("dfm_mixed_mariano_murasawa", dfm_mixed_mariano_murasawa, "panel", "factor"),
    ):
        MODELS[name] = ModelSpec(name, fit, kind, family)


_register()
