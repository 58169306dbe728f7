"""Selection of predictors by fitted models, supervised components and search strategies."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

import numpy as np

from . import structural
from .kernels import _coordinate_descent, _scaled, ols, random_forest, ridge


def _how_many(n_features: float, p: int) -> int:
    return max(1, int(n_features * p)) if isinstance(n_features, float) and n_features <= 1 else int(n_features)


def lasso_selection(x, y, n_features=0.5, alpha=0.01) -> np.ndarray:
    z, _, _ = _scaled(x)
    b = _coordinate_descent(z, y - y.mean(), alpha, 0.0)
    return np.argsort(-np.abs(b), kind="stable")[: _how_many(n_features, x.shape[1])]


def lasso_path_selection(x, y, n_features=0.5, n_alphas=20) -> np.ndarray:
    """By the share of the path at which a column is active."""
    z, _, _ = _scaled(x)
    yc = y - y.mean()
    top = np.abs(z.T @ yc / len(y)).max()
    active = sum((_coordinate_descent(z, yc, a, 0.0, 500, 1e-6) != 0).astype(float) for a in top * np.logspace(-0.05, -2, n_alphas))
    return np.argsort(-active, kind="stable")[: _how_many(n_features, x.shape[1])]


def rfe_selection(x, y, n_features=0.5) -> np.ndarray:
    """Drop the least standardised coefficient until enough are left."""
    z, _, _ = _scaled(x)
    left = list(range(x.shape[1]))
    while len(left) > _how_many(n_features, x.shape[1]):
        left.pop(int(np.argmin(np.abs(ridge(z[:, left], y, 1e-6).coef))))
    return np.array(left)


def stability_selection(x, y, threshold=0.6, n_subsamples=50, alpha=0.05, random_state=0) -> tuple[np.ndarray, np.ndarray]:
    """Columns active in a share of half samples, and the shares."""
    rng, share = np.random.default_rng(random_state), np.zeros(x.shape[1])
    z, _, _ = _scaled(x)
    for _ in range(n_subsamples):
        ids = rng.choice(len(y), len(y) // 2, replace=False)
        share += (_coordinate_descent(z[ids] - z[ids].mean(0), y[ids] - y[ids].mean(), alpha, 0.0, 500, 1e-6) != 0) / n_subsamples
    return np.flatnonzero(share >= threshold), share


def boruta_selection(x, y, rounds=10, random_state=0) -> np.ndarray:
    """Columns whose permutation importance beats the best shuffled copy in most rounds."""
    from .interpret import permutation_importance

    rng, wins, p = np.random.default_rng(random_state), np.zeros(x.shape[1]), x.shape[1]
    for r in range(rounds):
        both = np.column_stack([x, rng.permuted(x, axis=0)])
        f = random_forest(both, y, n_estimators=20, random_state=r)
        imp = permutation_importance(f, both, y, 1, r)
        wins += imp[:p] > imp[p:].max()
    return np.flatnonzero(wins > rounds / 2)


def genetic_selection(x, y, n_features=0.5, population=20, generations=10, random_state=0) -> np.ndarray:
    """Masks that evolve on the error of the last third."""
    rng, p, cut = np.random.default_rng(random_state), x.shape[1], 2 * len(y) // 3
    k = _how_many(n_features, p)

    def loss(s):
        c = np.flatnonzero(s)
        return float(((ridge(x[:cut][:, c], y[:cut], 1e-3)(x[cut:][:, c]) - y[cut:]) ** 2).mean())

    def fixed(s):
        on = rng.permutation(np.flatnonzero(s))[:k]
        off = rng.permutation(np.setdiff1d(np.arange(p), on))[: k - len(on)]
        out = np.zeros(p, bool)
        out[np.concatenate([on, off]).astype(int)] = True
        return out

    pop = [fixed(rng.random(p) < 0.5) for _ in range(population)]
    for _ in range(generations):
        pop.sort(key=loss)
        parents = pop[: population // 2]
        pop = parents + [fixed(np.where(rng.random(p) < 0.5, *[parents[i] for i in rng.integers(0, len(parents), 2)]) ^ (rng.random(p) < 0.1)) for _ in parents]
    return np.flatnonzero(min(pop, key=loss))


def sliced_inverse_regression(x, y, n_components=2, n_slices=10) -> np.ndarray:
    """Directions of the slice means of whitened columns."""
    xc = x - x.mean(0)
    u, s, v = np.linalg.svd(xc, full_matrices=False)
    keep = s > s[0] * 1e-8
    white = u[:, keep] * np.sqrt(len(x))
    parts = np.array_split(np.argsort(y, kind="stable"), n_slices)
    m = sum(len(i) / len(y) * np.outer(white[i].mean(0), white[i].mean(0)) for i in parts)
    d = np.linalg.eigh(m)[1][:, ::-1][:, :n_components]
    return (v[keep].T / s[keep] * np.sqrt(len(x))) @ d


def nystroem(x, n_components=10, gamma=None, random_state=0) -> np.ndarray:
    """Features whose inner products approximate a Gaussian kernel."""
    g = 1 / x.shape[1] if gamma is None else gamma
    marks = x[np.random.default_rng(random_state).choice(len(x), min(n_components, len(x)), replace=False)]
    k = lambda a, b: np.exp(-g * ((a[:, None] - b[None]) ** 2).sum(2))
    w, q = np.linalg.eigh(k(marks, marks))
    return k(x, marks) @ q / np.sqrt(np.maximum(w, 1e-12))


def sparse_components(x, n_components=2, keep=0.5, sweeps=50) -> np.ndarray:
    """Loadings thresholded to a share of the columns, one component after the other."""
    z, _, _ = _scaled(x)
    out, e = [], z.copy()
    k = _how_many(keep, x.shape[1])
    for _ in range(n_components):
        v = np.linalg.svd(e, full_matrices=False)[2][0]
        for _ in range(sweeps):
            w = e.T @ (e @ v)
            cut = np.sort(np.abs(w))[-k]
            w = np.sign(w) * np.maximum(np.abs(w) - (np.sort(np.abs(w))[-k - 1] if k < len(w) else 0.0), 0) if cut else w
            v = w / max(np.linalg.norm(w), 1e-300)
        t = e @ v
        e = e - np.outer(t, e.T @ t / max(t @ t, 1e-300))
        out.append(v)
    return np.array(out).T


albacore_components, albacore_ranks = structural.component_aggregation, structural.rank_aggregation


# Search strategies.


@dataclass(frozen=True)
class ParamDistribution:
    kind: str  # uniform, log_uniform, randint, choice
    low: float = 0.0
    high: float = 1.0
    values: tuple = ()

    def sample(self, rng: np.random.Generator):
        if self.kind == "choice":
            return self.values[int(rng.integers(len(self.values)))]
        if self.kind == "randint":
            return int(rng.integers(int(self.low), int(self.high)))
        if self.kind == "log_uniform":
            return float(np.exp(rng.uniform(np.log(self.low), np.log(self.high))))
        return float(rng.uniform(self.low, self.high))

    def unit(self, v) -> float:
        if self.kind == "choice":
            return self.values.index(v) / max(len(self.values) - 1, 1)
        a, b, c = (np.log(t) for t in (self.low, self.high, v)) if self.kind == "log_uniform" else (self.low, self.high, v)
        return float((c - a) / max(b - a, 1e-300))


def uniform(low, high):
    return ParamDistribution("uniform", low, high)


def log_uniform(low, high):
    return ParamDistribution("log_uniform", low, high)


def randint(low, high):
    return ParamDistribution("randint", low, high)


def choice(values):
    return ParamDistribution("choice", values=tuple(values))


def random_candidates(space: Mapping[str, ParamDistribution], n: int, random_state: int = 0) -> list[dict]:
    rng = np.random.default_rng(random_state)
    return [{k: d.sample(rng) for k, d in space.items()} for _ in range(n)]


def bayesian_search(loss: Callable[[dict], float], space: Mapping[str, ParamDistribution], n_iter: int = 20, start: int = 5, random_state: int = 0) -> tuple[dict, list]:
    """Gaussian process on the unit cube, expected improvement over a sampled pool; (best, trials)."""
    from ..functions.stats import norm_cdf, norm_pdf

    rng = np.random.default_rng(random_state)
    trials = [(p, loss(p)) for p in random_candidates(space, start, random_state)]
    code = lambda p: np.array([d.unit(p[k]) for k, d in space.items()])
    for _ in range(n_iter - start):
        x, y = np.array([code(p) for p, _ in trials]), np.array([v for _, v in trials])
        m, s = y.mean(), max(y.std(), 1e-12)
        kern = lambda a, b: np.exp(-((a[:, None] - b[None]) ** 2).sum(2) / 0.08)
        pool = [{k: d.sample(rng) for k, d in space.items()} for _ in range(200)]
        q = np.array([code(p) for p in pool])
        kx = kern(q, x)
        inv = np.linalg.inv(kern(x, x) + 1e-4 * np.eye(len(x)))
        mu = kx @ inv @ ((y - m) / s)
        sd = np.sqrt(np.maximum(1 - np.einsum("ij,jk,ik->i", kx, inv, kx), 1e-12))
        z = (((y - m) / s).min() - mu) / sd
        p = pool[int(np.argmax(sd * (z * norm_cdf(z) + norm_pdf(z))))]
        trials.append((p, loss(p)))
    return min(trials, key=lambda t: t[1])[0], trials


def genetic_search(loss: Callable[[dict], float], space: Mapping[str, ParamDistribution], population: int = 12, generations: int = 4, mutation: float = 0.2, random_state: int = 0) -> tuple[dict, list]:
    rng = np.random.default_rng(random_state)
    pop, trials = random_candidates(space, population, random_state), []
    for _ in range(generations):
        scored = sorted(((p, loss(p)) for p in pop), key=lambda t: t[1])
        trials += scored
        parents = [p for p, _ in scored[: max(2, population // 2)]]
        pop = [
            {k: d.sample(rng) if rng.random() < mutation else parents[int(rng.integers(len(parents)))][k] for k, d in space.items()} for _ in range(population)
        ]
    return min(trials, key=lambda t: t[1])[0], trials


def information_criterion(x, y, fits: Mapping[str, np.ndarray], criterion: str = "bic") -> str:
    """The candidate (columns) of least in-sample criterion."""

    def score(cols):
        e = y - ols(x[:, cols], y)(x[:, cols])
        n, k = len(y), len(cols) + 1
        pen = {"aic": 2 * k, "bic": k * np.log(n), "aicc": 2 * k + 2 * k * (k + 1) / max(n - k - 1, 1)}[criterion]
        return n * np.log(max(e @ e / n, 1e-300)) + pen

    return min(fits, key=lambda c: score(fits[c]))
