"""Model kernels in NumPy: what one group (series, origin) fits inside a grouped function.

``fit(x, y, **params)`` returns a function from new rows to predictions for
supervised models, ``fit(y, h, **params)`` a path of h forecasts for series models.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np

Predictor = Callable[[np.ndarray], np.ndarray]


def _linear(coef: np.ndarray, intercept: float = 0.0) -> Predictor:
    def predict(x: np.ndarray) -> np.ndarray:
        return x @ coef + intercept

    predict.coef, predict.intercept = coef, intercept  # type: ignore[attr-defined]
    return predict


def _centred(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    return x - x.mean(0), y - y.mean(), x.mean(0), float(y.mean())


def _scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m, s = x.mean(0), x.std(0)
    s = np.where(s > 0, s, 1)
    return (x - m) / s, m, s


# Linear models.


def ols(x, y):
    b = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0]
    return _linear(b[1:], float(b[0]))


def ridge(x, y, alpha=1.0, standardize=False):
    s = x.std(0) if standardize else np.ones(x.shape[1])
    s = np.where(s > 0, s, 1)
    xc, yc, xm, ym = _centred(x / s, y)
    b = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc) / s
    return _linear(b, ym - xm * s @ b)


def _coordinate_descent(x, y, l1, l2, max_iter=20000, tol=1e-10, weights=None):
    """min 1/(2n) |y - xb|² + l1 Σ w|b| + l2/2 |b|²."""
    n, p = x.shape
    w = np.ones(p) if weights is None else weights
    g, c, b = x.T @ x / n, x.T @ y / n, np.zeros(p)
    d = np.diag(g) + l2
    for _ in range(max_iter):
        most = 0.0
        for j in range(p):
            if d[j] <= 0:
                continue
            r = c[j] - g[j] @ b + g[j, j] * b[j]
            new = np.sign(r) * max(abs(r) - l1 * w[j], 0) / d[j]
            most = max(most, abs(new - b[j]))
            b[j] = new
        if most < tol:
            break
    return b


def elastic_net(x, y, alpha=1.0, l1_ratio=0.5, standardize=False, max_iter=20000, weights=None):
    s = np.where(x.std(0) > 0, x.std(0), 1) if standardize else np.ones(x.shape[1])
    xc, yc, xm, ym = _centred(x / s, y)
    b = _coordinate_descent(xc, yc, alpha * l1_ratio, alpha * (1 - l1_ratio), max_iter, weights=weights) / s
    return _linear(b, ym - xm * s @ b)


def lasso(x, y, alpha=1.0, **o):
    return elastic_net(x, y, alpha, 1.0, **o)


def adaptive_elastic_net(x, y, alpha=1.0, l1_ratio=0.5, gamma=1.0, initial_alpha=1.0, eps=1e-6):
    first = np.abs(ridge(x, y, initial_alpha).coef)
    return elastic_net(x, y, alpha, l1_ratio, weights=1 / (first + eps) ** gamma)


def adaptive_lasso(x, y, alpha=1.0, **o):
    return adaptive_elastic_net(x, y, alpha, 1.0, **o)


def sparse_group_lasso(x, y, groups=None, alpha=1.0, l1_ratio=0.5, max_iter=5000, tol=1e-9):
    """Proximal gradient; groups: a label per column."""
    xc, yc, xm, ym = _centred(x, y)
    n, p = x.shape
    labels = np.arange(p) if groups is None else np.asarray(groups)
    sets = [np.flatnonzero(labels == g) for g in np.unique(labels)]
    step = 1 / max(np.linalg.eigvalsh(xc.T @ xc / n)[-1], 1e-12)
    b = np.zeros(p)
    for _ in range(max_iter):
        z = b - step * (xc.T @ (xc @ b - yc) / n)
        z = np.sign(z) * np.maximum(np.abs(z) - step * alpha * l1_ratio, 0)
        for g in sets:
            norm = np.linalg.norm(z[g])
            z[g] *= max(0, 1 - step * alpha * (1 - l1_ratio) * np.sqrt(len(g)) / norm) if norm else 0
        if np.abs(z - b).max() < tol:
            b = z
            break
        b = z
    return _linear(b, ym - xm @ b)


def group_lasso(x, y, groups=None, alpha=1.0, **o):
    return sparse_group_lasso(x, y, groups, alpha, 0.0, **o)


def bayesian_ridge(x, y, max_iter=300, tol=1e-6):
    """Evidence maximisation."""
    xc, yc, xm, ym = _centred(x, y)
    n, p = x.shape
    ev, q = np.linalg.eigh(xc.T @ xc)
    ev, c = np.maximum(ev, 0), q.T @ (xc.T @ yc)
    a, lam = 1 / max(yc.var(), 1e-12), 1.0
    b = np.zeros(p)
    for _ in range(max_iter):
        new = q @ (a * c / (a * ev + lam))
        gamma = (a * ev / (a * ev + lam)).sum()
        lam = (gamma + 2e-6) / (new @ new + 2e-6)
        a = (n - gamma + 2e-6) / (((yc - xc @ new) ** 2).sum() + 2e-6)
        if np.abs(new - b).sum() < tol:
            b = new
            break
        b = new
    return _linear(b, ym - xm @ b)


def huber(x, y, epsilon=1.35, max_iter=200):
    """Iteratively reweighted least squares with a MAD scale."""
    z = np.column_stack([np.ones(len(x)), x])
    b = np.linalg.lstsq(z, y, rcond=None)[0]
    for _ in range(max_iter):
        r = y - z @ b
        s = max(np.median(np.abs(r - np.median(r))) / 0.6745, 1e-12)
        w = np.sqrt(np.minimum(1, epsilon * s / np.maximum(np.abs(r), 1e-12)))
        new = np.linalg.lstsq(z * w[:, None], y * w, rcond=None)[0]
        if np.abs(new - b).max() < 1e-10:
            break
        b = new
    return _linear(b[1:], float(b[0]))


def nonneg_ridge(x, y, alpha=1.0, fit_intercept=True, steps=2000):
    xc, yc, xm, ym = _centred(x, y) if fit_intercept else (x, y, np.zeros(x.shape[1]), 0.0)
    b = _projected(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc, lambda v: np.maximum(v, 0), steps)
    return _linear(b, ym - xm @ b)


def _projected(g, c, project, steps=2000):
    size = max(np.linalg.eigvalsh(g)[-1], 1e-300)
    b = z = project(np.zeros(len(c)))
    t = 1.0
    for _ in range(steps):
        new = project(z - (g @ z - c) / size)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, t, done = new + (t - 1) / t2 * (new - b), t2, np.abs(new - b).max() < 1e-12
        b = new
        if done:
            break
    return b


def shrink_to_target_ridge(x, y, alpha=1.0, prior_target=None, simplex=False, nonneg=False):
    from .combine import _simplex

    prior = np.full(x.shape[1], 1 / x.shape[1]) if prior_target is None else np.asarray(prior_target, float)
    if simplex:
        return _linear(_projected(x.T @ x + alpha * np.eye(x.shape[1]), x.T @ y + alpha * prior, _simplex))
    xc, yc, xm, ym = _centred(x, y)
    g, c = xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc + alpha * prior
    b = _projected(g, c, lambda v: np.maximum(v, 0)) if nonneg else np.linalg.solve(g, c)
    return _linear(b, ym - xm @ b)


def fused_difference_ridge(x, y, alpha=1.0, difference_order=1):
    xc, yc, xm, ym = _centred(x, y)
    d = np.diff(np.eye(x.shape[1]), difference_order, axis=0)
    b = np.linalg.lstsq(np.vstack([xc, np.sqrt(alpha) * d]), np.concatenate([yc, np.zeros(len(d))]), rcond=None)[0]
    return _linear(b, ym - xm @ b)


def random_walk_ridge(x, y, alpha=1.0, initial_alpha=1.0):
    """Coefficients that walk; the last ones predict (solved in the dual, n by n)."""
    z = np.column_stack([np.ones(len(x)), x])
    n, p = z.shape
    steps = np.minimum.outer(np.arange(n), np.arange(n))
    k = (z @ z.T) * (steps / alpha + 1 / initial_alpha)
    a = np.linalg.solve(k + np.eye(n), y)
    b = (z * (np.arange(n)[:, None] / alpha + 1 / initial_alpha)).T @ a
    return _linear(b[1:], float(b[0]))


def tvp_ridge(x, y, lambdas=(1.0, 10.0, 100.0, 1000.0), kfold=5):
    """Random-walk coefficients, the penalty picked on past-only blocks."""
    cuts = [len(y) * i // kfold for i in range(1, kfold + 1)]

    def loss(a):
        return sum(((random_walk_ridge(x[:i], y[:i], a)(x[i:j]) - y[i:j]) ** 2).sum() for i, j in zip(cuts, cuts[1:]) if i > 3)

    return random_walk_ridge(x, y, min(lambdas, key=loss))


def glmboost(x, y, n_iter=100, learning_rate=0.1):
    """Componentwise L2 boosting."""
    xc, yc, xm, ym = _centred(x, y)
    ss, b, r = np.maximum((xc**2).sum(0), 1e-12), np.zeros(x.shape[1]), yc.copy()
    for _ in range(n_iter):
        c = xc.T @ r
        j = int(np.argmax(c**2 / ss))
        b[j] += learning_rate * c[j] / ss[j]
        r -= learning_rate * c[j] / ss[j] * xc[:, j]
    return _linear(b, ym - xm @ b)


def pls(x, y, n_components=3):
    z, m, s = _scaled(x)
    yc, ws, ps, qs, e = y - y.mean(), [], [], [], z.copy()
    f = yc.copy()
    for _ in range(min(n_components, x.shape[1], len(x) - 1)):
        w = e.T @ f
        if np.linalg.norm(w) < 1e-12:
            break
        w /= np.linalg.norm(w)
        t = e @ w
        p, q = e.T @ t / (t @ t), f @ t / (t @ t)
        e, f = e - np.outer(t, p), f - q * t
        ws.append(w), ps.append(p), qs.append(q)
    if not ws:
        return _linear(np.zeros(x.shape[1]), float(y.mean()))
    w, p = np.array(ws).T, np.array(ps).T
    b = w @ np.linalg.solve(p.T @ w, np.array(qs)) / s
    return _linear(b, float(y.mean()) - m @ b)


def principal_components(z: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and loadings; the largest loading of each is positive."""
    _, _, v = np.linalg.svd(z, full_matrices=False)
    v = v[: min(k, len(v))]
    v = v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])[:, None]
    return z @ v.T, v


def pcr(x, y, n_components=3, scale_by=None, keep=None):
    cols = np.arange(x.shape[1]) if keep is None else keep
    z, m, s = _scaled(x[:, cols])
    weight = np.ones(len(cols)) if scale_by is None else scale_by(z, y)
    _, v = principal_components(z * weight, n_components)
    fit = ols((z * weight) @ v.T, y)
    b = np.zeros(x.shape[1])
    b[cols] = (v.T @ fit.coef) * weight / s
    return _linear(b, fit.intercept - m @ b[cols])


def _slopes(z, y):
    return z.T @ (y - y.mean()) / np.maximum((z**2).sum(0), 1e-12)


def scaled_pca(x, y, n_components=3):
    return pcr(x, y, n_components, _slopes)


def _screened(x, y, n_selected, min_abs_corr):
    z, _, _ = _scaled(x)
    c = np.abs(z.T @ (y - y.mean())) / len(y) / max(y.std(), 1e-12)
    keep = np.argsort(-c, kind="stable")[:n_selected]
    keep = keep[c[keep] >= min_abs_corr]
    return np.sort(keep) if len(keep) else np.array([int(c.argmax())])


def supervised_pca(x, y, n_components=3, n_selected=50, min_abs_corr=0.0):
    return pcr(x, y, n_components, None, _screened(x, y, n_selected, min_abs_corr))


def supervised_scaled_pca(x, y, n_components=3, n_selected=50, min_abs_corr=0.0):
    return pcr(x, y, n_components, _slopes, _screened(x, y, n_selected, min_abs_corr))


def csr(x, y, k=4, max_subsets=5000, random_state=1071):
    """Mean of OLS over all (or sampled) subsets of k columns."""
    p = x.shape[1]
    k = min(k, p)
    from math import comb

    if comb(p, k) <= max_subsets:
        sets = list(combinations(range(p), k))
    else:
        rng = np.random.default_rng(random_state)
        sets = [tuple(rng.choice(p, k, replace=False)) for _ in range(max_subsets)]
    b, a = np.zeros(p), 0.0
    for s in sets:
        f = ols(x[:, s], y)
        b[list(s)] += f.coef / len(sets)
        a += f.intercept / len(sets)
    return _linear(b, a)


def jma(x, y):
    """Jackknife averaging of nested OLS models."""
    from .combine import constrained_ls_weights

    fits, loo = [], []
    for k in range(x.shape[1] + 1):
        z = np.column_stack([np.ones(len(x)), x[:, :k]])
        h = np.einsum("ij,ji->i", z, np.linalg.pinv(z))
        f = ols(x[:, :k], y)
        fits.append((np.append(f.coef, np.zeros(x.shape[1] - k)), f.intercept))
        loo.append(y - (y - f(x[:, :k])) / np.maximum(1 - h, 1e-8))
    w = constrained_ls_weights(np.array(loo).T, y)
    return _linear(sum(wi * c for wi, (c, _) in zip(w, fits)), float(sum(wi * a for wi, (_, a) in zip(w, fits))))


# Nonparametric models.


def kernel_ridge(x, y, alpha=1.0, kernel="rbf", gamma=None, degree=3, coef0=1.0):
    g = 1 / x.shape[1] if gamma is None else gamma

    def k(a, b):
        if kernel == "linear":
            return a @ b.T
        if kernel == "poly":
            return (g * a @ b.T + coef0) ** degree
        return np.exp(-g * ((a[:, None] - b[None]) ** 2).sum(2))

    dual = np.linalg.solve(k(x, x) + alpha * np.eye(len(x)), y)
    return lambda new: k(new, x) @ dual


def knn(x, y, n_neighbors=5, weights="uniform"):
    def predict(new):
        d = np.sqrt(((new[:, None] - x[None]) ** 2).sum(2))
        near = np.argsort(d, axis=1, kind="stable")[:, : min(n_neighbors, len(x))]
        w = np.ones(near.shape) if weights == "uniform" else 1 / np.maximum(np.take_along_axis(d, near, 1), 1e-12)
        return (w * y[near]).sum(1) / w.sum(1)

    return predict


@dataclass
class Tree:
    """A regression tree in arrays; ``members`` are the training rows of each leaf."""

    feature: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    members: list[np.ndarray] = field(default_factory=list)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        f, c, lo, hi = (np.array(v) for v in (self.feature, self.cut, self.left, self.right))
        for _ in range(len(f)):
            inner = f[at] >= 0
            if not inner.any():
                break
            go = x[np.arange(len(x)), np.maximum(f[at], 0)] <= c[at]
            at = np.where(inner, np.where(go, lo[at], hi[at]), at)
        return at

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(x)]


def grow_tree(x, y, max_depth=None, min_samples_leaf=1, max_features=None, rng=None, random_cut=False) -> Tree:
    t = Tree()

    def add(ids, depth):
        node = len(t.value)
        for store, v in ((t.feature, -1), (t.cut, 0.0), (t.left, -1), (t.right, -1), (t.value, float(y[ids].mean())), (t.members, ids)):
            store.append(v)
        if len(ids) < 2 * min_samples_leaf or (max_depth is not None and depth >= max_depth) or np.ptp(y[ids]) == 0:
            return node
        cols = np.arange(x.shape[1]) if max_features is None else rng.choice(x.shape[1], max(1, min(max_features, x.shape[1])), replace=False)
        best = (1e-12, -1, 0.0)
        base = ((y[ids] - y[ids].mean()) ** 2).sum()
        for j in cols:
            v = x[ids, j]
            if random_cut:
                if v.max() == v.min():
                    continue
                c = rng.uniform(v.min(), v.max())
                lo = v <= c
                n = lo.sum()
                if min_samples_leaf <= n <= len(ids) - min_samples_leaf:
                    gain = base - sum(((y[ids][s] - y[ids][s].mean()) ** 2).sum() for s in (lo, ~lo))
                    best = max(best, (gain, int(j), float(c)))
                continue
            order = np.argsort(v, kind="stable")
            vs, ys = v[order], y[ids][order]
            s1, s2, n = np.cumsum(ys), np.cumsum(ys**2), np.arange(1, len(ids) + 1)
            k = np.arange(min_samples_leaf - 1, len(ids) - min_samples_leaf)
            k = k[vs[k] < vs[k + 1]]
            if not len(k):
                continue
            sse = s2[k] - s1[k] ** 2 / n[k] + (s2[-1] - s2[k]) - (s1[-1] - s1[k]) ** 2 / (len(ids) - n[k])
            i = int(np.argmin(sse))
            if base - sse[i] > best[0]:
                best = (base - sse[i], int(j), float((vs[k[i]] + vs[k[i] + 1]) / 2))
        if best[1] < 0:
            return node
        _, j, c = best
        lo = x[ids, j] <= c
        t.feature[node], t.cut[node] = j, c
        t.left[node] = add(ids[lo], depth + 1)
        t.right[node] = add(ids[~lo], depth + 1)
        return node

    add(np.arange(len(y)), 0)
    return t


def decision_tree(x, y, max_depth=None, min_samples_leaf=1):
    return grow_tree(x, y, max_depth, min_samples_leaf)


def _forest(x, y, n, max_features, max_depth, min_samples_leaf, seed, bootstrap, random_cut):
    rng = np.random.default_rng(seed)
    k = max(1, int(max_features * x.shape[1])) if isinstance(max_features, float) else max_features
    out = []
    for _ in range(n):
        ids = rng.integers(0, len(y), len(y)) if bootstrap else np.arange(len(y))
        out.append((grow_tree(x[ids], y[ids], max_depth, min_samples_leaf, k, rng, random_cut), ids))
    return out


def random_forest(x, y, n_estimators=100, max_features=1 / 3, max_depth=None, min_samples_leaf=5, random_state=0):
    trees = _forest(x, y, n_estimators, max_features, max_depth, min_samples_leaf, random_state, True, False)
    return lambda new: np.mean([t(new) for t, _ in trees], axis=0)


def extra_trees(x, y, n_estimators=100, max_features=1.0, max_depth=None, min_samples_leaf=1, random_state=0):
    trees = _forest(x, y, n_estimators, max_features, max_depth, min_samples_leaf, random_state, False, True)
    return lambda new: np.mean([t(new) for t, _ in trees], axis=0)


def quantile_regression_forest(x, y, quantiles=(0.05, 0.5, 0.95), n_estimators=100, min_samples_leaf=5, random_state=0):
    """Quantiles of the leaf members of all trees; the prediction is the middle one."""
    trees = _forest(x, y, n_estimators, 1 / 3, None, min_samples_leaf, random_state, True, False)

    def quantile(new):
        pools = [np.concatenate([y[ids[t.members[leaf]]] for (t, ids), leaf in zip(trees, row)]) for row in np.array([t.leaves(new) for t, _ in trees]).T]
        return np.array([np.quantile(p, quantiles) for p in pools])

    def predict(new):
        return quantile(new)[:, len(quantiles) // 2]

    predict.quantiles = quantile
    return predict


def gradient_boosting(x, y, n_estimators=100, learning_rate=0.1, max_depth=3, subsample=1.0, random_state=0):
    rng, f, trees = np.random.default_rng(random_state), np.full(len(y), y.mean()), []
    for _ in range(n_estimators):
        ids = rng.choice(len(y), max(2, int(subsample * len(y))), replace=False) if subsample < 1 else np.arange(len(y))
        t = grow_tree(x[ids], (y - f)[ids], max_depth)
        f = f + learning_rate * t(x)
        trees.append(t)
    base = float(y.mean())
    return lambda new: base + learning_rate * sum(t(new) for t in trees)


def macro_random_forest(x, y, n_estimators=30, min_samples_leaf=10, ridge_alpha=1.0, max_features=1 / 3, random_state=0):
    """Forest on all columns whose leaves carry a ridge regression on the columns."""
    trees = _forest(x, y, n_estimators, max_features, None, min_samples_leaf, random_state, True, False)
    local = [{i: ridge(x[ids[m]], y[ids[m]], ridge_alpha) for i, m in enumerate(t.members) if t.feature[i] < 0} for t, ids in trees]

    def predict(new):
        out = np.zeros(len(new))
        for (t, _), fits in zip(trees, local):
            leaf = t.leaves(new)
            for i in np.unique(leaf):
                out[leaf == i] += fits[i](new[leaf == i]) / len(trees)
        return out

    return predict


def mars(x, y, max_terms=20, n_knots=10, penalty=3.0):
    """Additive hinges: forward pairs, backward by generalised cross-validation."""
    n, terms, basis = len(y), [], np.ones((len(y), 1))
    knots = [np.unique(np.quantile(x[:, j], np.linspace(0.05, 0.95, n_knots))) for j in range(x.shape[1])]

    def hinge(v, k, s):
        return np.maximum(s * (v - k), 0)

    def rss(b):
        return float(((y - b @ np.linalg.lstsq(b, y, rcond=None)[0]) ** 2).sum())

    now = rss(basis)
    while basis.shape[1] + 2 <= min(max_terms, n // 2):
        options = [(rss(np.column_stack([basis, hinge(x[:, j], k, 1), hinge(x[:, j], k, -1)])), j, k) for j in range(x.shape[1]) for k in knots[j]]
        best, j, k = min(options)
        if now - best < 1e-6 * max(now, 1e-12):
            break
        now = best
        terms += [(j, k, 1), (j, k, -1)]
        basis = np.column_stack([basis, hinge(x[:, j], k, 1), hinge(x[:, j], k, -1)])

    def gcv(keep):
        b = np.column_stack([np.ones(n), *[hinge(x[:, terms[i][0]], terms[i][1], terms[i][2]) for i in keep]])
        c = len(keep) + 1 + penalty * len(keep) / 2
        return rss(b) / n / max(1 - c / n, 1e-3) ** 2

    keep = list(range(len(terms)))
    score = gcv(keep)
    while keep:
        s, i = min((gcv([t for t in keep if t != i]), i) for i in keep)
        if s > score:
            break
        score = s
        keep.remove(i)
    b = np.column_stack([np.ones(n), *[hinge(x[:, terms[i][0]], terms[i][1], terms[i][2]) for i in keep]])
    coef = np.linalg.lstsq(b, y, rcond=None)[0]
    return lambda new: np.column_stack([np.ones(len(new)), *[hinge(new[:, terms[i][0]], terms[i][1], terms[i][2]) for i in keep]]) @ coef


def nn(x, y, hidden=32, steps=500, learning_rate=0.01, l2=1e-4, random_state=0):
    """One hidden layer, Adam, full batch."""
    z, m, s = _scaled(x)
    ym, ys = y.mean(), max(y.std(), 1e-12)
    t, rng = (y - ym) / ys, np.random.default_rng(random_state)
    w = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), hidden), np.zeros(1)]
    a, b = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w]
    for i in range(1, steps + 1):
        pre = z @ w[0] + w[1]
        act = np.maximum(pre, 0)
        d = 2 * (act @ w[2] + w[3] - t) / len(t)
        back = np.outer(d, w[2]) * (pre > 0)
        grads = [z.T @ back + l2 * w[0], back.sum(0), act.T @ d + l2 * w[2], np.array([d.sum()])]
        for v, g, p, q in zip(w, grads, a, b):
            p += 0.1 * (g - p)
            q += 0.001 * (g * g - q)
            v -= learning_rate * (p / (1 - 0.9**i)) / (np.sqrt(q / (1 - 0.999**i)) + 1e-8)
    return lambda new: (np.maximum((new - m) / s @ w[0] + w[1], 0) @ w[2] + w[3]) * ys + ym


def midas_weights(kind: str, n: int, **o) -> np.ndarray:
    """Columns of lag weights: Almon powers, a beta curve, or steps."""
    k = np.arange(n)
    if kind == "almon":
        return np.vander(k, o.get("polynomial_order", 2) + 1, increasing=True).astype(float)
    if kind == "beta":
        a, b = o.get("beta_params", (1.0, 5.0))
        u = (k + 0.5) / n
        w = u ** (a - 1) * (1 - u) ** (b - 1)
        return (w / w.sum())[:, None]
    steps = o.get("n_steps", 3)
    return (k[:, None] * steps // n == np.arange(steps)[None]).astype(float)


def midas(x, y, weighting="almon", alpha=0.0, **o):
    """Least squares on weighted lags (columns of ``x`` are lags, newest first)."""
    w = midas_weights(weighting, x.shape[1], **o)
    f = ridge(x @ w, y, alpha) if alpha else ols(x @ w, y)
    return _linear(w @ f.coef, f.intercept)


def unrestricted_midas(x, y, alpha=0.0):
    return ridge(x, y, alpha) if alpha else ols(x, y)


# Series models: a path of forecasts.


def s_naive(y, h):
    return np.full(h, y[-1])


def s_hist_mean(y, h, window=None):
    return np.full(h, (y[-window:] if window else y).mean())


def s_drift(y, h):
    return y[-1] + np.arange(1, h + 1) * (y[-1] - y[0]) / max(len(y) - 1, 1)


def s_seasonal_naive(y, h, period=12):
    return np.array([y[len(y) - period + (i % period)] if len(y) >= period else y[-1] for i in range(h)])


def lag_design(y: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    return np.column_stack([y[p - k : len(y) - k] for k in range(1, p + 1)]), y[p:]


def s_ar(y, h, n_lag=1):
    x, t = lag_design(y, n_lag)
    f, path = ols(x, t), list(y)
    for _ in range(h):
        path.append(float(f(np.array(path[: -n_lag - 1 : -1])[None])[0]))
    return np.array(path[len(y) :])


def select_ar_order(y, max_lag=12, criterion="bic"):
    best = (np.inf, 1)
    top = min(max_lag, (len(y) - 2) // 2)
    for p in range(1, top + 1):
        x, t = lag_design(y[top - p :], p)
        e = t - ols(x, t)(x)
        n, k = len(t), p + 1
        pen = {"aic": 2 * k, "bic": k * np.log(n), "aicc": 2 * k + 2 * k * (k + 1) / max(n - k - 1, 1)}[criterion]
        best = min(best, (n * np.log(max(e @ e / n, 1e-300)) + pen, p))
    return best[1]


def s_ar_bic(y, h, max_lag=12, criterion="bic"):
    return s_ar(y, h, select_ar_order(y, max_lag, criterion))


def s_setar(y, h, n_lag=2):
    """Two regimes by the first lag; the threshold of least squared error in the inner 70 %."""
    x, t = lag_design(y, n_lag)
    best = (np.inf, None)
    for c in np.unique(np.quantile(x[:, 0], np.linspace(0.15, 0.85, 30))):
        lo = x[:, 0] <= c
        if min(lo.sum(), (~lo).sum()) <= n_lag + 2:
            continue
        a, b = ols(x[lo], t[lo]), ols(x[~lo], t[~lo])
        sse = ((t[lo] - a(x[lo])) ** 2).sum() + ((t[~lo] - b(x[~lo])) ** 2).sum()
        if sse < best[0]:
            best = (sse, (c, a, b))
    if best[1] is None:
        return s_ar(y, h, n_lag)
    c, a, b = best[1]
    path = list(y)
    for _ in range(h):
        r = np.array(path[: -n_lag - 1 : -1])[None]
        path.append(float((a if r[0, 0] <= c else b)(r)[0]))
    return np.array(path[len(y) :])


def nelder_mead(f, x0, steps=400, size=0.1):
    x0 = np.asarray(x0, float)
    pts = [x0] + [x0 + size * (np.arange(len(x0)) == i) for i in range(len(x0))]
    v = [f(p) for p in pts]
    for _ in range(steps):
        o = np.argsort(v)
        pts, v = [pts[i] for i in o], [v[i] for i in o]
        if abs(v[-1] - v[0]) < 1e-10:
            break
        c = np.mean(pts[:-1], axis=0)
        r = c + (c - pts[-1])
        fr = f(r)
        if fr < v[0]:
            e = c + 2 * (c - pts[-1])
            fe = f(e)
            pts[-1], v[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < v[-2]:
            pts[-1], v[-1] = r, fr
        else:
            k = c + 0.5 * (pts[-1] - c)
            fk = f(k)
            if fk < v[-1]:
                pts[-1], v[-1] = k, fk
            else:
                pts = [pts[0]] + [pts[0] + 0.5 * (p - pts[0]) for p in pts[1:]]
                v = [v[0]] + [f(p) for p in pts[1:]]
    return pts[int(np.argmin(v))]


def _sig(u):
    return 1 / (1 + np.exp(-np.clip(u, -30, 30)))


def s_holt_winters(y, h, trend="add", seasonal=None, seasonal_periods=12, damped_trend=False):
    """Additive exponential smoothing, parameters by least one-step squared error."""
    m = seasonal_periods if seasonal and len(y) >= 2 * seasonal_periods else 0

    def run(p, out=False):
        a, b, g = _sig(p[0]), _sig(p[1]) if trend else 0.0, _sig(p[2]) if m else 0.0
        phi = 0.8 + 0.18 * _sig(p[3]) if damped_trend else 1.0
        level, slope = (y[:m].mean(), (y[m : 2 * m].mean() - y[:m].mean()) / m) if m else (y[0], y[1] - y[0] if trend else 0.0)
        slope = slope if trend else 0.0
        season = list(y[:m] - y[:m].mean()) if m else []
        sse = 0.0
        for t in range(m or 1, len(y)):
            s = season[t % m] if m else 0.0
            e = y[t] - (level + phi * slope + s)
            sse += e * e
            new = level + phi * slope + a * e
            slope = phi * slope + a * b * e if trend else 0.0
            level = new
            if m:
                season[t % m] = s + g * (1 - a) * e
        if not out:
            return sse
        damp = np.cumsum(phi ** np.arange(1, h + 1))
        return level + damp * slope + (np.array([season[(len(y) + i) % m] for i in range(h)]) if m else 0.0)

    return run(nelder_mead(run, np.array([0.0, -2.0, -2.0, 1.0]), 200, 0.5), True)


def s_ets(y, h, trend=None, seasonal=None, seasonal_periods=12, damped_trend=False):
    return s_holt_winters(y, h, trend, seasonal, seasonal_periods, damped_trend)


def s_theta(y, h):
    """Half the linear trend and simple smoothing with its drift."""
    n = len(y)
    b = np.polyfit(np.arange(n), y, 1)[0]

    def sse(p, out=False):
        a, level, total = _sig(p[0]), y[0], 0.0
        for v in y[1:]:
            total += (v - level) ** 2
            level += a * (v - level)
        return (a, level) if out else total

    a, level = sse(nelder_mead(sse, np.array([0.0]), 100, 0.5), True)
    return level + b / 2 * (np.arange(h) + 1 / a - (1 - a) ** n / a)


def s_arima(y, h, order=(1, 0, 0)):
    """Conditional sum of squares."""
    p, d, q = order
    z = np.diff(y, d) if d else y
    mu = z.mean()

    def resid(c):
        e, w = np.zeros(len(z)), z - mu - c[-1]
        for t in range(len(z)):
            e[t] = w[t] - sum(c[i] * w[t - 1 - i] for i in range(min(p, t))) - sum(c[p + j] * e[t - 1 - j] for j in range(min(q, t)))
        return e

    c = nelder_mead(lambda v: float((resid(v)[p:] ** 2).sum()) if np.abs(v[:-1]).sum() < 10 else 1e300, np.zeros(p + q + 1), 300)
    e, w = list(resid(c)), list(z - mu - c[-1])
    for _ in range(h):
        w.append(sum(c[i] * w[-1 - i] for i in range(p)) + sum(c[p + j] * e[-1 - j] for j in range(q)))
        e.append(0.0)
    path = np.array(w[len(z) :]) + mu + c[-1]
    for k in range(d):
        path = np.cumsum(path) + np.diff(y, d - 1 - k)[-1]
    return path


def garch_variance(y, h, variant="garch11"):
    """Variance forecasts of (GJR-)GARCH(1,1) by Gaussian quasi-likelihood."""
    e = y - y.mean()
    v0 = max(e.var(), 1e-12)

    def path(p):
        a, g, b = 0.3 * _sig(p[0]), (0.3 * _sig(p[2]) if variant == "gjr" else 0.0), 0.98 * _sig(p[1])
        keep = max(1 - a - b - g / 2, 1e-4)
        s = np.empty(len(e) + 1)
        s[0] = v0
        for t in range(len(e)):
            s[t + 1] = keep * v0 + (a + g * (e[t] < 0)) * e[t] ** 2 + b * s[t]
        return s, a + b + g / 2

    def nll(p):
        s, _ = path(p)
        return float(np.log(s[:-1]).sum() + (e**2 / s[:-1]).sum())

    s, decay = path(nelder_mead(nll, np.array([-1.0, 1.5, -1.0]), 200, 0.5))
    return v0 + (s[-1] - v0) * min(decay, 0.9999) ** np.arange(h)


# Vector autoregressions.


def var_fit(z: np.ndarray, n_lag: int, prior: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Intercepts and stacked lag matrices (rows: equations); ``prior`` shrinks Minnesota-style to random walks."""
    n, k = z.shape
    x = np.column_stack([np.ones(n - n_lag), *[z[n_lag - j : n - j] for j in range(1, n_lag + 1)]])
    y = z[n_lag:]
    if prior is None:
        b = np.linalg.lstsq(x, y, rcond=None)[0].T
    else:
        s = np.array([max((z[1:, i] - z[:-1, i]).std(), 1e-9) for i in range(k)])
        b = np.empty((k, 1 + k * n_lag))
        for i in range(k):
            sd = np.concatenate([[1e3], *[prior / j * s[i] / s * np.where(np.arange(k) == i, 1, 0.5) for j in range(1, n_lag + 1)]])
            mean = np.zeros(1 + k * n_lag)
            mean[1 + i] = 1.0
            w = s[i] ** 2 / sd**2
            b[i] = np.linalg.solve(x.T @ x + np.diag(w), x.T @ y[:, i] + w * mean)
    return b[:, 0], b[:, 1:]


def var_forecast(z, h, n_lag=1, prior=None):
    a, b = var_fit(z, n_lag, prior)
    path = list(z)
    for _ in range(h):
        path.append(a + b @ np.concatenate(path[: -n_lag - 1 : -1]))
    return np.array(path[len(z) :])


def companion(b: np.ndarray, k: int, n_lag: int) -> np.ndarray:
    c = np.zeros((k * n_lag, k * n_lag))
    c[:k] = b
    c[k:, : k * (n_lag - 1)] = np.eye(k * (n_lag - 1))
    return c


def var_roots(z, n_lag=1):
    return np.abs(np.linalg.eigvals(companion(var_fit(z, n_lag)[1], z.shape[1], n_lag)))


def impulse_responses(z, n_lag=1, periods=10, orthogonal=True):
    """(periods + 1, response, shock)."""
    a, b = var_fit(z, n_lag)
    k = z.shape[1]
    x = np.column_stack([z[n_lag - j : len(z) - j] for j in range(1, n_lag + 1)])
    e = z[n_lag:] - a - x @ b.T
    shock = np.linalg.cholesky(e.T @ e / (len(e) - k * n_lag - 1)) if orthogonal else np.eye(k)
    c, power, out = companion(b, k, n_lag), np.eye(k * n_lag), []
    for _ in range(periods + 1):
        out.append(power[:k, :k] @ shock)
        power = power @ c
    return np.array(out)


def fevd(z, n_lag=1, periods=10):
    """Share of each shock in the forecast variance, (periods, response, shock)."""
    r = np.cumsum(impulse_responses(z, n_lag, periods - 1) ** 2, axis=0)
    return r / r.sum(2, keepdims=True)


@dataclass(frozen=True)
class ModelSpec:
    name: str
    fit: Callable
    kind: str  # supervised, target, panel
    family: str
    search: dict[str, list] = field(default_factory=dict)


_A = {"alpha": [0.01, 0.1, 1.0, 10.0]}
_K = {"n_components": [1, 2, 3]}
MODELS: dict[str, ModelSpec] = {
    m.name: m
    for m in [
        ModelSpec("ols", ols, "supervised", "linear"), ModelSpec("ridge", ridge, "supervised", "linear", _A), ModelSpec("lasso", lasso, "supervised", "linear", _A),
        ModelSpec("elastic_net", elastic_net, "supervised", "linear", _A), ModelSpec("adaptive_lasso", adaptive_lasso, "supervised", "linear", _A),
        ModelSpec("adaptive_elastic_net", adaptive_elastic_net, "supervised", "linear", _A), ModelSpec("group_lasso", group_lasso, "supervised", "linear", _A),
        ModelSpec("sparse_group_lasso", sparse_group_lasso, "supervised", "linear", _A), ModelSpec("bayesian_ridge", bayesian_ridge, "supervised", "linear"),
        ModelSpec("huber", huber, "supervised", "linear"), ModelSpec("nonneg_ridge", nonneg_ridge, "supervised", "linear", _A),
        ModelSpec("shrink_to_target_ridge", shrink_to_target_ridge, "supervised", "linear", _A), ModelSpec("fused_difference_ridge", fused_difference_ridge, "supervised", "linear", _A),
        ModelSpec("random_walk_ridge", random_walk_ridge, "supervised", "linear", _A), ModelSpec("tvp_ridge", tvp_ridge, "supervised", "linear"),
        ModelSpec("glmboost", glmboost, "supervised", "boosting"), ModelSpec("pls", pls, "supervised", "factor", _K), ModelSpec("pcr", pcr, "supervised", "factor", _K),
        ModelSpec("scaled_pca", scaled_pca, "supervised", "factor", _K), ModelSpec("supervised_pca", supervised_pca, "supervised", "factor", _K),
        ModelSpec("supervised_scaled_pca", supervised_scaled_pca, "supervised", "factor", _K), ModelSpec("csr", csr, "supervised", "averaging"), ModelSpec("jma", jma, "supervised", "averaging"),
        ModelSpec("kernel_ridge", kernel_ridge, "supervised", "kernel", _A), ModelSpec("knn", knn, "supervised", "kernel", {"n_neighbors": [3, 5, 10]}), ModelSpec("mars", mars, "supervised", "spline"),
        ModelSpec("nn", nn, "supervised", "neural"), ModelSpec("decision_tree", decision_tree, "supervised", "tree"), ModelSpec("random_forest", random_forest, "supervised", "tree"),
        ModelSpec("extra_trees", extra_trees, "supervised", "tree"), ModelSpec("gradient_boosting", gradient_boosting, "supervised", "tree"),
        ModelSpec("quantile_regression_forest", quantile_regression_forest, "supervised", "tree"), ModelSpec("macro_random_forest", macro_random_forest, "supervised", "tree"),
        ModelSpec("restricted_midas", midas, "supervised", "midas"), ModelSpec("unrestricted_midas", unrestricted_midas, "supervised", "midas"),
        ModelSpec("midas_almon", lambda x, y, **o: midas(x, y, "almon", **o), "supervised", "midas"), ModelSpec("midas_beta", lambda x, y, **o: midas(x, y, "beta", **o), "supervised", "midas"),
        ModelSpec("midas_step", lambda x, y, **o: midas(x, y, "step", **o), "supervised", "midas"),
        ModelSpec("naive", s_naive, "target", "series"), ModelSpec("hist_mean", s_hist_mean, "target", "series"), ModelSpec("random_walk_drift", s_drift, "target", "series"),
        ModelSpec("seasonal_naive", s_seasonal_naive, "target", "series"), ModelSpec("ar", s_ar, "target", "series"), ModelSpec("ar_bic", s_ar_bic, "target", "series"),
        ModelSpec("setar", s_setar, "target", "series"), ModelSpec("holt_winters", s_holt_winters, "target", "series"), ModelSpec("ets", s_ets, "target", "series"),
        ModelSpec("theta_method", s_theta, "target", "series"), ModelSpec("arima", s_arima, "target", "series"),
        ModelSpec("garch11", garch_variance, "volatility", "volatility"), ModelSpec("gjr_garch", lambda y, h: garch_variance(y, h, "gjr"), "volatility", "volatility"),
        ModelSpec("var", var_forecast, "panel", "vector"), ModelSpec("bvar_minnesota", lambda z, h, n_lag=1: var_forecast(z, h, n_lag, 0.2), "panel", "vector"),
    ]
}


def get_model(name: str) -> ModelSpec:
    if name not in MODELS:
        raise KeyError(f"unknown model {name}")
    return MODELS[name]


def custom_model(name: str, fit: Callable, kind: str = "supervised") -> ModelSpec:
    MODELS[name] = ModelSpec(name, fit, kind, "custom")
    return MODELS[name]
