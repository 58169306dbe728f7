"""Support vectors, boosted trees of several growth rules, hybrids of trees and lines, and stacked ensembles."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Mapping, Sequence

import numpy as np

from .kernels import MODELS, ModelSpec, _scaled, get_model, grow_tree

# Support vector regression.


def kernel_matrix(a: np.ndarray, b: np.ndarray, kernel: str, gamma: float, degree: int, coef0: float) -> np.ndarray:
    if kernel == "linear":
        return a @ b.T
    if kernel == "poly":
        return (gamma * (a @ b.T) + coef0) ** degree
    if kernel == "sigmoid":
        return np.tanh(gamma * (a @ b.T) + coef0)
    return np.exp(-gamma * np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0))


def smo(k: np.ndarray, y: np.ndarray, c: float, epsilon: float, tol: float = 1e-3, max_iter: int = 100_000) -> tuple[np.ndarray, float]:
    """Dual weights and intercept of epsilon-insensitive regression: pairs of greatest violation, each solved exactly."""
    n = len(y)
    beta, g = np.zeros(n), -y.astype(float)
    for _ in range(max_iter):
        # What the objective gains per unit when a weight rises, or loses when it falls.
        rise = np.where(beta < c - 1e-12, g + epsilon * np.where(beta >= 0, 1, -1), np.inf)
        fall = np.where(beta > -c + 1e-12, g + epsilon * np.where(beta > 0, 1, -1), -np.inf)
        i, j = int(np.argmin(rise)), int(np.argmax(fall))
        if fall[j] - rise[i] < tol:
            break
        eta = max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
        lo, hi = max(-c - beta[i], beta[j] - c), min(c - beta[i], beta[j] + c)
        worth = lambda d: 0.5 * eta * d * d + (g[i] - g[j]) * d + epsilon * (abs(beta[i] + d) + abs(beta[j] - d))  # noqa: E731, B023
        still = [-(g[i] - g[j] + epsilon * (s - t)) / eta for s in (-1, 1) for t in (-1, 1)]
        d = min((float(np.clip(v, lo, hi)) for v in [*still, -beta[i], beta[j]]), key=worth)
        if abs(d) < 1e-14:
            break
        beta[i] += d
        beta[j] -= d
        g += d * (k[:, i] - k[:, j])
    rise = np.where(beta < c - 1e-12, g + epsilon * np.where(beta >= 0, 1, -1), np.inf)
    fall = np.where(beta > -c + 1e-12, g + epsilon * np.where(beta > 0, 1, -1), -np.inf)
    return beta, -float(rise.min() + fall.max()) / 2


def _gamma(x: np.ndarray, gamma) -> float:
    if gamma == "scale":
        return 1 / max(x.shape[1] * x.var(), 1e-12)
    return 1 / x.shape[1] if gamma == "auto" else float(gamma)


def svr(x, y, kernel="rbf", C=1.0, epsilon=0.1, gamma="scale", degree=3, coef0=0.0, tol=1e-3):
    g = _gamma(x, gamma)
    beta, b = smo(kernel_matrix(x, x, kernel, g, degree, coef0), y, C, epsilon, tol)
    held = np.abs(beta) > 1e-12
    predict = lambda new: kernel_matrix(new, x[held], kernel, g, degree, coef0) @ beta[held] + b
    predict.support, predict.dual, predict.intercept = np.flatnonzero(held), beta[held], b
    return predict


def nu_svr(x, y, kernel="rbf", C=1.0, nu=0.5, gamma="scale", degree=3, coef0=0.0, tol=1e-3):
    """The tube is as wide as makes the dual weights sum to ``nu`` of their bound; the width is bisected."""
    g = _gamma(x, gamma)
    k = kernel_matrix(x, x, kernel, g, degree, coef0)
    lo, hi = 0.0, float(np.ptp(y)) / 2 + 1e-12
    for _ in range(30):
        mid = (lo + hi) / 2
        used = np.abs(smo(k, y, C, mid, tol)[0]).sum() / (C * len(y))
        lo, hi = (mid, hi) if used > nu else (lo, mid)
    return svr(x, y, kernel, C, (lo + hi) / 2, g, degree, coef0, tol)


def linear_svr(x, y, C=1.0, epsilon=0.0, loss="epsilon_insensitive", tol=1e-4, max_iter=20_000):
    """Accelerated projected gradient on the dual; the intercept is a column of ones and penalised like the others."""
    z = np.column_stack([x, np.ones(len(x))])
    soft = 0.5 / C if loss.startswith("squared") else 0.0
    top = np.inf if soft else C
    size = np.linalg.norm(z, 2) ** 2 + soft
    beta = ahead = np.zeros(len(y))
    t = 1.0
    for _ in range(max_iter):
        v = ahead - (z @ (z.T @ ahead) + soft * ahead - y) / size
        new = np.clip(np.sign(v) * np.maximum(np.abs(v) - epsilon / size, 0), -top, top)
        step = new - beta
        if np.abs(step).max() < tol / 100 * max(1.0, np.abs(new).max()):
            beta = new
            break
        if (ahead - new) @ step > 0:  # the momentum points uphill: start it anew
            t = 1.0
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, beta, t = new + (t - 1) / t_new * step, new, t_new
    w = z.T @ beta
    predict = lambda new: new @ w[:-1] + w[-1]
    predict.coef, predict.intercept = w[:-1], float(w[-1])
    return predict


# Boosted trees: depth first, best leaf first, or one cut per level.


class Leaves:
    """A list of (feature, cut, left, right, value); node 0 is the root."""

    def __init__(self):
        self.nodes: list[list] = []

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), int)
        feature, cut, left, right, value = (np.array([n[i] for n in self.nodes]) for i in range(5))
        for _ in range(len(self.nodes)):
            inner = feature[at] >= 0
            if not inner.any():
                break
            go = x[np.arange(len(x)), np.maximum(feature[at], 0).astype(int)] <= cut[at]
            at = np.where(inner, np.where(go, left[at], right[at]), at).astype(int)
        return value[at]


def _bins(x: np.ndarray, n: int = 63) -> list[np.ndarray]:
    """Cut points between neighbouring values, at most ``n`` a column."""
    out = []
    for v in x.T:
        u = np.unique(v)
        mids = (u[1:] + u[:-1]) / 2
        out.append(mids if len(mids) <= n else np.unique(mids[np.linspace(0, len(mids) - 1, n).astype(int)]))
    return out


def _best_cut(x, r, ids, cuts, least, l2):
    """(gain, feature, cut) of the split with the greatest drop of the penalised loss."""
    s, n = r[ids].sum(), len(ids)
    best = (0.0, -1, 0.0)
    for j, c in enumerate(cuts):
        if not len(c):
            continue
        bin_of = np.searchsorted(c, x[ids, j], "left")
        count, total = (np.cumsum(np.bincount(bin_of, w, len(c) + 1))[:-1] for w in (None, r[ids]))
        ok = (count >= least) & (n - count >= least)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(ok, total**2 / (count + l2) + (s - total) ** 2 / (n - count + l2) - s * s / (n + l2), 0.0)
        i = int(np.argmax(gain))
        if gain[i] > best[0] + 1e-12:
            best = (float(gain[i]), j, float(c[i]))
    return best


def leafwise_tree(x, r, cuts, max_leaves=31, least=20, l2=0.0, max_depth=-1) -> Leaves:
    """The leaf of greatest gain is split until there are ``max_leaves``."""
    t = Leaves()
    ids = np.arange(len(r))
    value = lambda i: float(r[i].sum() / (len(i) + l2)) if len(i) else 0.0
    t.nodes.append([-1, 0.0, 0, 0, value(ids)])
    todo = [(-b[0], 0, 0, ids, b) for b in [_best_cut(x, r, ids, cuts, least, l2)] if b[1] >= 0]
    while todo and sum(n[0] < 0 for n in t.nodes) < max_leaves:
        _, node, depth, ids, (_, j, c) = heapq.heappop(todo)
        low = x[ids, j] <= c
        t.nodes[node][:4] = [j, c, len(t.nodes), len(t.nodes) + 1]
        for part in (ids[low], ids[~low]):
            t.nodes.append([-1, 0.0, 0, 0, value(part)])
            b = _best_cut(x, r, part, cuts, least, l2)
            if b[1] >= 0 and (max_depth < 0 or depth + 1 < max_depth):
                heapq.heappush(todo, (-b[0], len(t.nodes) - 1, depth + 1, part, b))
    return t


def oblivious_tree(x, r, cuts, depth=6, l2=3.0) -> Callable[[np.ndarray], np.ndarray]:
    """One cut for all leaves of a level."""
    leaf, chosen = np.zeros(len(r), int), []
    for _ in range(depth):
        best = (1e-12, -1, 0.0)
        n, s = np.bincount(leaf, minlength=leaf.max() + 1), np.bincount(leaf, r, leaf.max() + 1)
        base = (s**2 / np.maximum(n + l2, 1e-12)).sum()
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            cell = np.searchsorted(c, x[:, j], "left")
            table = lambda w: np.cumsum(np.bincount(leaf * (len(c) + 1) + cell, w, len(n) * (len(c) + 1)).reshape(len(n), -1), 1)[:, :-1]  # noqa: E731, B023
            ln, ls = table(None), table(r)
            gain = (ls**2 / np.maximum(ln + l2, 1e-12) + (s[:, None] - ls) ** 2 / np.maximum(n[:, None] - ln + l2, 1e-12)).sum(0) - base
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (float(gain[i]), j, float(c[i]))
        if best[1] < 0:
            break
        chosen.append(best[1:])
        leaf = leaf * 2 + (x[:, best[1]] > best[2])
    size = 1 << len(chosen)
    value = np.bincount(leaf, r, size) / np.maximum(np.bincount(leaf, minlength=size) + l2, 1e-12)

    def predict(new):
        at = np.zeros(len(new), int)
        for j, c in chosen:
            at = at * 2 + (new[:, j] > c)
        return value[at]

    return predict


def _boosted(x, y, n_estimators, learning_rate, subsample, random_state, grow):
    rng, base = np.random.default_rng(random_state), float(y.mean())
    f, trees = np.full(len(y), base), []
    for _ in range(n_estimators):
        ids = rng.choice(len(y), max(2, int(subsample * len(y))), replace=False) if subsample < 1 else np.arange(len(y))
        t = grow(x[ids], (y - f)[ids])
        f = f + learning_rate * t(x)
        trees.append(t)
    predict = lambda new: base + learning_rate * np.sum([t(new) for t in trees], axis=0)
    predict.trees = trees
    return predict


def xgboost(x, y, n_estimators=300, learning_rate=0.1, max_depth=6, subsample=1.0, reg_lambda=1.0, random_state=0):
    """Second-order boosting with an L2 penalty on leaf values, grown to a depth."""
    cuts = _bins(x)
    grow = lambda a, r: leafwise_tree(a, r, cuts, 1 << max_depth, 1, reg_lambda, max_depth)
    return _boosted(x, y, n_estimators, learning_rate, subsample, random_state, grow)


def lightgbm(x, y, n_estimators=300, learning_rate=0.1, max_depth=-1, num_leaves=31, min_child_samples=20, random_state=0):
    """Histogram boosting, best leaf first."""
    cuts = _bins(x, 254)
    grow = lambda a, r: leafwise_tree(a, r, cuts, num_leaves, min_child_samples, 0.0, max_depth)
    return _boosted(x, y, n_estimators, learning_rate, 1.0, random_state, grow)


def catboost(x, y, n_estimators=300, learning_rate=0.1, max_depth=6, l2_leaf_reg=3.0, random_state=0):
    """Boosting with symmetric trees."""
    cuts = _bins(x)
    return _boosted(x, y, n_estimators, learning_rate, 1.0, random_state, lambda a, r: oblivious_tree(a, r, cuts, max_depth, l2_leaf_reg))


# Trees against lines.


def lgb_plus(
    x, y, n_ensemble=3, n_steps=30, learning_rate=0.05, subsample=0.7, num_leaves=5, min_data_in_leaf=20, lambda_l2=0.1,
    linear_candidate_fraction=0.5, selection_method="oob", val_fraction=0.2, early_stop_patience=50, aggregation="mean", random_state=0,
):
    """At each step a tree and a line through the origin in one column compete; the lower loss on the judging rows joins."""
    cuts, members, shares = _bins(x), [], []
    base, p = float(y.mean()), x.shape[1]
    for m in range(n_ensemble):
        rng = np.random.default_rng([random_state or 0, m])
        f, steps, best, since = np.full(len(y), base), [], (np.inf, 0), 0
        cut = len(y) - max(1, int(val_fraction * len(y)))
        for _ in range(n_steps):
            pool = np.arange(cut) if selection_method == "validation" else np.arange(len(y))
            ids = rng.choice(pool, max(2, int(subsample * len(pool))), replace=False)
            judge = {"validation": np.arange(cut, len(y)), "training": ids}.get(selection_method, np.setdiff1d(pool, ids))
            judge = judge if len(judge) else ids
            r = y - f
            tree = leafwise_tree(x[ids], r[ids], cuts, num_leaves, min(min_data_in_leaf, max(1, len(ids) // 3)), lambda_l2)
            cols = rng.choice(p, max(1, int(round(linear_candidate_fraction * p))), replace=False)
            xc = x[np.ix_(ids, cols)]
            power = np.maximum((xc**2).sum(0), 1e-300)
            fit = np.abs(xc.T @ r[ids]) / np.sqrt(power)
            j = int(cols[int(np.argmax(fit))])
            slope = float(x[ids, j] @ r[ids] / max(x[ids, j] @ x[ids, j], 1e-300))
            line = lambda new, j=j, slope=slope: slope * new[:, j]
            loss = {k: float(((r[judge] - learning_rate * g(x[judge])) ** 2).mean()) for k, g in (("tree", tree), ("linear", line))}
            kind = min(loss, key=loss.get)
            steps.append((kind, tree if kind == "tree" else line))
            f = f + learning_rate * steps[-1][1](x)
            best, since = ((loss[kind], len(steps)), 0) if loss[kind] < best[0] else (best, since + 1)
            if early_stop_patience is not None and since >= early_stop_patience:
                break
        if selection_method == "validation":
            steps = steps[: best[1]]
        members.append(steps)
        shares.append(np.mean([k == "linear" for k, _ in steps]))
    pool = np.median if aggregation == "median" else np.mean
    predict = lambda new: pool([base + learning_rate * sum(g(new) for _, g in steps) for steps in members], axis=0)
    predict.linear_share = float(np.mean(shares))
    return predict


def lgba_plus(x, y, n_runs=1, n_cycles=25, trees_per_cycle=10, lr_tree=0.02, lr_linear=0.1, num_leaves=15, min_data_in_leaf=20, subsample=1.0, random_state=0):
    """Cycles of some trees, then one damped least-squares step on all columns, each on what is left."""
    z, m, s = _scaled(x)
    cuts, base, runs = _bins(x), float(y.mean()), []
    for run in range(n_runs):
        rng, f, parts = np.random.default_rng([random_state or 0, run]), np.full(len(y), base), []
        for _ in range(n_cycles):
            for _ in range(trees_per_cycle):
                ids = rng.choice(len(y), max(2, int(subsample * len(y))), replace=False) if subsample < 1 else np.arange(len(y))
                t = leafwise_tree(x[ids], (y - f)[ids], cuts, num_leaves, min(min_data_in_leaf, max(1, len(ids) // 3)))
                parts.append(lambda new, t=t: lr_tree * t(new))
                f = f + parts[-1](x)
            b = np.linalg.lstsq(np.column_stack([np.ones(len(z)), z]), y - f, rcond=None)[0]
            parts.append(lambda new, b=b: lr_linear * (b[0] + (new - m) / s @ b[1:]))
            f = f + parts[-1](x)
        runs.append(parts)
    return lambda new: np.mean([base + sum(g(new) for g in parts) for parts in runs], axis=0)


# Ensembles fitted at once.


def forward_folds(n: int, n_splits: int, splitter: str = "forward") -> list[tuple[np.ndarray, np.ndarray]]:
    """(train, held) positions: ``forward`` trains on the past only, ``blocked`` on all other blocks, ``kfold`` on all other classes."""
    if splitter == "forward":
        cuts = [n * i // (n_splits + 1) for i in range(1, n_splits + 2)]
        return [(np.arange(a), np.arange(a, b)) for a, b in zip(cuts, cuts[1:])]
    label = np.arange(n) % n_splits if splitter == "kfold" else np.arange(n) * n_splits // n
    return [(np.flatnonzero(label != i), np.flatnonzero(label == i)) for i in range(n_splits)]


def stacking(x, y, models: Sequence[str] = ("ridge", "lasso", "random_forest"), meta_model="ridge", n_splits=5, splitter="forward",
             model_params: Mapping[str, dict] | None = None, meta_params: dict | None = None, passthrough=False):
    """A meta model on out-of-fold predictions of the base models."""
    if not models or len(set(models)) != len(models):
        raise ValueError("models must be unique and not empty")
    options = model_params or {}
    fit = lambda name, a, b: get_model(name).fit(a, b, **options.get(name, {}))
    rows, out = [], []
    for train, held in forward_folds(len(y), max(2, n_splits), splitter):
        rows.append(held)
        out.append(np.column_stack([fit(name, x[train], y[train])(x[held]) for name in models]))
    at, oof = np.concatenate(rows), np.concatenate(out)
    meta = get_model(meta_model).fit(np.column_stack([oof, x[at]]) if passthrough else oof, y[at], **(meta_params or {}))
    whole = [fit(name, x, y) for name in models]

    def predict(new):
        base = np.column_stack([g(new) for g in whole])
        return meta(np.column_stack([base, new]) if passthrough else base)

    predict.oof, predict.rows, predict.meta = oof, at, meta
    return predict


def _share(k, p: int, default: int) -> int:
    if k is None:
        return default
    if k == "sqrt":
        return max(1, int(np.sqrt(p)))
    if k == "log2":
        return max(1, int(np.log2(p)))
    return max(1, min(p, int(k * p) if isinstance(k, float) else int(k)))


def booging(
    x, y, B=100, sample_frac=0.75, inner_n_estimators=1000, inner_learning_rate=0.3, inner_max_depth=3, inner_subsample=0.5, mtry=None,
    data_aug=False, noise_level=0.3, shuffle_rate=0.2, n_augmented_copies=2, scale_continuous=True, random_state=0,
):
    """Bagging of boosting models that overfit on purpose; noisy copies of the columns may be added to their pool."""
    two = np.array([len(np.unique(v)) <= 2 for v in x.T])
    m, s = np.where(two | (not scale_continuous), 0, x.mean(0)), np.where(two | (not scale_continuous) | (x.std(0) == 0), 1, x.std(0))
    z, members = (x - m) / s, []
    wide = lambda a: np.column_stack([a] * (1 + n_augmented_copies if data_aug else 1))
    for b in range(B):
        rng = np.random.default_rng([random_state, b])
        ids = rng.choice(len(y), max(2, int(sample_frac * len(y))), replace=False)
        a = wide(z[ids])
        for j in range(x.shape[1], a.shape[1]):
            v = a[:, j].copy()
            if two[j % x.shape[1]]:
                some = rng.choice(len(v), int(shuffle_rate * len(v)), replace=False)
                v[some] = v[rng.permutation(some)]
            else:
                v = v + noise_level * rng.normal(size=len(v)) * max(v.std(), 1e-12)
            a[:, j] = v
        cols = np.sort(rng.choice(a.shape[1], _share(mtry, a.shape[1], max(1, int(0.8 * a.shape[1]))), replace=False))
        grow = lambda p, r: grow_tree(p, r, inner_max_depth)
        members.append((cols, _boosted(a[:, cols], y[ids], inner_n_estimators, inner_learning_rate, inner_subsample, int(rng.integers(1 << 31)), grow)))
    return lambda new: np.mean([f(wide((new - m) / s)[:, cols]) for cols, f in members], axis=0)


for _name, _fit, _family in (
    ("svr", svr, "kernel"), ("nu_svr", nu_svr, "kernel"), ("linear_svr", linear_svr, "linear"), ("xgboost", xgboost, "boosted"), ("lightgbm", lightgbm, "boosted"),
    ("catboost", catboost, "boosted"), ("lgb_plus", lgb_plus, "boosted"), ("lgba_plus", lgba_plus, "boosted"), ("stacking", stacking, "ensemble"), ("booging", booging, "ensemble"),
):
    MODELS[_name] = ModelSpec(_name, _fit, "supervised", _family)
