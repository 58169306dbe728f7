"""Networks, support vectors, boosted trees, ensembles and state-space kernels against closed forms and plain versions."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from tidecast.functions.autodiff import Tensor, joined, stacked, tensor
from tidecast.operators import learners as L
from tidecast.operators import networks as N
from tidecast.operators import structural as S
from tidecast.operators.kernels import ols, ridge


def numeric(f, x, eps=1e-6):
    g = np.zeros_like(x)
    for i in np.ndindex(x.shape):
        for s in (1, -1):
            z = x.copy()
            z[i] += s * eps
            g[i] += s * f(z) / (2 * eps)
    return g


EXPRESSIONS = [
    lambda t: (t @ np.arange(6.0).reshape(3, 2)).tanh().sum(), lambda t: (t.softmax() * np.arange(3.0)).sum(), lambda t: (t.normed() ** 2.0 * np.arange(12.0).reshape(4, 3)).sum(),
    lambda t: ((t * t + 1).log() / (t.exp() + 2)).mean(), lambda t: (t.sigmoid() - t.softplus() * t.relu()).sum(0).sum(), lambda t: joined([t, t * 2], 1)[1:, 2:5].sum(),
    lambda t: (stacked([t, t.tanh()], 1) @ np.ones((3, 2))).mean(), lambda t: (t @ t.turned() * 0.1).exp().sum(), lambda t: (1 - t)[0].sum() - (-t).mean(1, True).sum(),
]


@pytest.mark.parametrize("k", range(len(EXPRESSIONS)))
def test_gradients_are_those_of_small_steps(k):
    x = np.random.default_rng(k).normal(size=(4, 3)) + 0.05
    t = Tensor(x)
    EXPRESSIONS[k](t).backward()
    assert t.grad == pytest.approx(numeric(lambda z: float(EXPRESSIONS[k](tensor(z)).value), x), abs=1e-5)


@pytest.mark.parametrize("fit", [N.lstm, N.gru, N.transformer])
def test_sequence_networks(fit):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 2))
    y = np.concatenate([[0.0], x[:-1, 0]]) + 0.5 * x[:, 1]  # needs the row before
    f = fit(x[:100], y[:100], sequence_length=3, hidden_size=8, learning_rate=0.02, max_epochs=60)
    assert ((f(x[100:]) - y[100:]) ** 2).mean() < 0.5 * y.var() and f.trace[-1] < f.trace[0]
    g = f.gradient(x[100:104])
    for r in range(4):  # a row's own derivative; the rows after it see it as history
        assert g[r] == pytest.approx(numeric(lambda v: f(np.vstack([x[100 : 100 + r], v[None]]))[-1], x[100 + r]), abs=1e-4)
    assert f.hidden(x[100:104]).shape == (4, 8)
    assert (fit(x[:100], y[:100], max_epochs=2)(x[100:]) == fit(x[:100], y[:100], max_epochs=2)(x[100:])).all()


@pytest.mark.parametrize("fit", [N.hemisphere_nn, N.density_hnn])
def test_hemispheres_tell_quiet_from_loud(fit):
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (300, 1))
    y = x[:, 0] + np.where(x[:, 0] > 0, 1.0, 0.1) * rng.normal(size=300)
    f = fit(x, y, neurons=16, n_estimators=4, learning_rate=0.01, max_epochs=60, dropout=0.0, patience=60, random_state=2)
    v = f.variance(np.array([[-0.6], [0.6]]))
    assert v[1] > 2 * v[0]
    q = f.quantiles(x[:5])
    assert (np.diff(q, axis=1) > 0).all() and f.gradient(x[:5]).shape == (5, 1)


def test_support_vectors_meet_the_optimality_conditions():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 2))
    y = np.sin(x[:, 0]) + 0.1 * rng.normal(size=60)
    c, eps = 2.0, 0.1
    k = L.kernel_matrix(x, x, "rbf", 0.5, 3, 0.0)
    beta, b = L.smo(k, y, c, eps, 1e-6)
    e = y - k @ beta - b
    assert abs(beta.sum()) < 1e-9 and np.abs(beta).max() <= c + 1e-9
    inside, bound = np.abs(beta) < 1e-9, np.abs(beta) > c - 1e-9
    assert (np.abs(e[inside]) <= eps + 1e-4).all() and (np.abs(e[bound]) >= eps - 1e-4).all()
    free = ~inside & ~bound
    assert np.abs(e[free]) == pytest.approx(np.full(free.sum(), eps), abs=1e-4)


def test_nu_is_the_share_of_the_weights():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 2))
    y = x[:, 0] ** 2 + 0.3 * rng.normal(size=50)
    for nu in (0.2, 0.6):
        f = L.nu_svr(x, y, C=1.0, nu=nu, tol=1e-5)
        assert np.abs(f.dual).sum() / 50 == pytest.approx(nu, abs=0.02)


def test_linear_support_vectors_against_a_fine_search():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 2))
    y = 1 + x @ np.array([2.0, -1.0]) + rng.normal(size=80)
    for loss, power in (("epsilon_insensitive", 1), ("squared_epsilon_insensitive", 2)):
        f = L.linear_svr(x, y, 0.5, 0.2, loss, 1e-8)
        worth = lambda w: 0.5 * w @ w + 0.5 * (np.maximum(np.abs(y - x @ w[:2] - w[2]) - 0.2, 0) ** power).sum()  # noqa: E731, B023
        at = np.array([*f.coef, f.intercept])
        assert all(worth(at) <= worth(at + d) + 1e-7 for d in rng.normal(size=(300, 3)) * rng.choice([1e-3, 0.05, 0.5], (300, 1)))


def test_leafwise_tree_takes_the_best_splits():
    x = np.arange(40.0)[:, None]
    r = np.repeat([0.0, 5.0, -3.0, 1.0], 10)
    t = L.leafwise_tree(x, r, L._bins(x), 4, 1)
    assert (t(x) == r).all() and sum(n[0] < 0 for n in t.nodes) == 4
    assert len(np.unique(L.leafwise_tree(x, r, L._bins(x), 2, 1)(x))) == 2
    assert min(np.unique(L.leafwise_tree(x, r, L._bins(x), 31, 7)(x), return_counts=True)[1]) >= 7


def test_symmetric_tree_cuts_all_leaves_alike():
    g = np.array(list(itertools.product(range(4), range(4))), float)
    r = (g[:, 0] > 1) * 2.0 + (g[:, 1] > 0)
    assert L.oblivious_tree(g, r, L._bins(g), 2, 0.0)(g) == pytest.approx(r)


def test_hybrids_take_lines_where_the_truth_is_one():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(150, 3))
    line = L.lgb_plus(x, 3 * x[:, 0], n_ensemble=1, n_steps=40, linear_candidate_fraction=1.0)
    step = L.lgb_plus(x, np.where(np.abs(x[:, 0]) > 1, 4.0, 0.0), n_ensemble=1, n_steps=40, linear_candidate_fraction=1.0)
    assert line.linear_share > 0.8 > 0.4 > step.linear_share


def test_stacking_trains_forward():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(90, 3))
    y = x @ np.array([1.0, 2.0, 3.0])
    for train, held in L.forward_folds(90, 5):
        assert train.max() < held.min()
    f = L.stacking(x, y, ("ols", "pcr"), "ols")
    assert f(x) == pytest.approx(y, abs=1e-6) and len(f.oof) == 75
    by_hand = np.concatenate([ols(x[t], y[t])(x[h]) for t, h in L.forward_folds(90, 5)])
    assert f.oof[:, 0] == pytest.approx(by_hand)
    with pytest.raises(ValueError):
        L.stacking(x, y, ("ols", "ols"))


def test_booging_copies_columns():
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.normal(size=80), rng.integers(0, 2, 80)])
    f = L.booging(x, x[:, 0] + x[:, 1], 4, inner_n_estimators=50, data_aug=True)
    assert ((f(x) - x[:, 0] - x[:, 1]) ** 2).mean() < 0.3


# State space.


def test_smoother_is_the_conditional_mean():
    rng = np.random.default_rng(9)
    z = rng.normal(size=(7, 1))
    z[3] = np.nan
    a, q, c, r = np.array([[0.8]]), np.array([[0.5]]), np.array([[1.3]]), np.array([0.2])
    m, p, cross, loglik = S.kalman_smoother(z, c, a, q, r, np.zeros(1), np.array([[2.0]]))
    v = np.zeros((7, 7))  # covariance of the states
    for i in range(7):
        v[i, i] = 2.0 if i == 0 else 0.64 * v[i - 1, i - 1] + 0.5
        for j in range(i):
            v[i, j] = v[j, i] = 0.8 ** (i - j) * v[j, j]
    ok = np.isfinite(z[:, 0])
    s = 1.69 * v[np.ix_(ok, ok)] + 0.2 * np.eye(6)
    gain = 1.3 * v[:, ok] @ np.linalg.inv(s)
    left = v - gain @ (1.3 * v[ok])
    assert m[:, 0] == pytest.approx(gain @ z[ok, 0]) and p[:, 0, 0] == pytest.approx(np.diag(left))
    assert cross[1:, 0, 0] == pytest.approx(np.diag(left, 1))
    x = z[ok, 0]
    assert loglik == pytest.approx(-0.5 * (np.linalg.slogdet(s)[1] + x @ np.linalg.solve(s, x) + 6 * np.log(2 * np.pi)))


def mixed_panel(seed=0, n=180):
    rng = np.random.default_rng(seed)
    f = np.zeros(n)
    for t in range(1, n):
        f[t] = 0.7 * f[t - 1] + rng.normal()
    monthly = f[:, None] * np.array([1.0, 0.8, -0.6]) + 0.3 * rng.normal(size=(n, 3))
    slow = np.full(n, np.nan)
    whole = np.convolve(f, [1, 2, 3, 2, 1])[: n] / 3
    slow[2::3] = whole[2::3] + 0.1 * rng.normal(size=len(slow[2::3]))
    return f, np.column_stack([monthly, slow])


def test_mixed_frequency_factor_is_found():
    f, z = mixed_panel()
    m = S.MixedFactorModel(z, (3,), maxiter=15)
    assert abs(np.corrcoef(m.factors[:, 0], f)[0, 1]) > 0.95
    assert all(b >= a - 1e-3 * abs(a) for a, b in zip(m.trace, m.trace[1:]))  # EM does not fall
    ahead = S.dfm_mixed_mariano_murasawa(z, 3, (3,), maxiter=5)
    assert ahead.shape == (3, 4) and np.isfinite(ahead).all()
    g = S.dfm_unrestricted_midas(z, 3, (3,), lag_columns=(0,), factor_lags=(0, 1, 2), maxiter=5)
    x = g.design[g.rows]
    assert 1 - ((g(x) - z[g.rows, 3]) ** 2).mean() / np.nanvar(z[:, 3]) > 0.9


def test_restricted_vector_autoregression_drops_the_noise():
    rng = np.random.default_rng(10)
    z = np.zeros((300, 2))
    for t in range(1, 300):
        z[t] = [0.6 * z[t - 1, 0], 0.5 * z[t - 1, 1] + 0.4 * z[t - 1, 0]] + rng.normal(size=2)
    b, t = S.var_restrict(z, 1)
    assert b[0, 2] == 0 and b[1, 1] != 0 and b[1, 2] != 0 and (np.abs(t[b != 0]) >= 2).all()
    parts, base = S.historical_decomposition(z, 1)
    assert parts.sum(2) + base == pytest.approx(z[1:])
    for test in (S.var_serial_test, S.var_normality_test, S.var_arch_test):
        assert test(z)["p_value"] > 0.01
    wild = np.random.default_rng(11).standard_t(2, size=(300, 2))
    assert S.var_normality_test(wild)["p_value"] < 0.01


def test_volatility_paths():
    rng = np.random.default_rng(12)
    s, y, rv = 1.0, [], []
    for _ in range(400):
        s = 0.1 + 0.1 * abs(y[-1] if y else 0) + 0.05 * (max(-y[-1], 0) if y else 0) + 0.8 * s
        y.append(s * rng.normal())
        rv.append(s**2 * np.exp(0.2 * rng.normal()))
    y, rv = np.array(y), np.array(rv)
    for path in (S.tgarch(y, 5), S.realized_garch(y, 5, rv, 600)):
        assert path.shape == (5,) and (path > 0).all() and 0.2 < path.mean() / y.var() < 5
    assert S.tgarch(np.append(y, -8.0), 1)[0] > S.tgarch(np.append(y, 0.0), 1)[0]


# Aggregation weights against a fine search.


@pytest.mark.parametrize("kind", ["simplex", "nonneg", "mean", "fused", "target"])
def test_aggregation_weights_are_the_constrained_minimum(kind):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(60, 3)) + 1
    y = x @ np.array([0.7, 0.4, -0.1]) + 0.2 * rng.normal(size=60)
    sd, m, alpha = x.std(0, ddof=1), x.mean(0), 5.0
    ref = np.array([0.2, 0.2, 0.6])
    w = {
        "simplex": lambda: S.solve_simplex_ridge(x, y, alpha), "nonneg": lambda: S.solve_nonnegative_ridge(x, y, alpha), "mean": lambda: S.solve_mean_aligned_ridge(x, y, alpha),
        "fused": lambda: S.solve_fused_difference_ridge(x, y, alpha), "target": lambda: S.solve_target_shrinkage_ridge(x, y, ref, alpha),
    }[kind]()

    def worth(v):
        pen = (np.diff(sd * v) ** 2).sum() if kind == "fused" else (sd * (v - (ref if kind == "target" else 0)) ** 2).sum()
        return ((y - x @ v) ** 2).sum() + alpha * pen

    assert (w >= -1e-9).all()
    if kind in ("simplex", "target"):
        assert w.sum() == pytest.approx(1)
        others = rng.dirichlet(np.ones(3), 3000)
    else:
        others = np.maximum(w + rng.normal(size=(3000, 3)) * rng.choice([0.01, 0.1], (3000, 1)), 0)
        if kind in ("mean", "fused"):
            assert m @ w == pytest.approx(y.mean(), abs=1e-6)
            others *= y.mean() / np.maximum(others @ m, 1e-9)[:, None]
    assert all(worth(w) <= worth(v) + 1e-6 for v in others)


def test_rank_space_sorts_first():
    x = np.random.default_rng(14).normal(size=(200, 3))
    r = S.rank_aggregation(x, np.sort(x, 1)[:, 1], alpha=1e-6, mean_match=False).weights
    assert r == pytest.approx([0, 1, 0], abs=0.05)
    assert S.assemblage_regression(x, x[:, 0], alpha=1e-6).weights == pytest.approx([1, 0, 0], abs=0.02)
    free = S.solve_weights(x, x @ np.array([1.0, -2.0, 0.5]), 1e-9, nonneg=False)
    assert free == pytest.approx(ridge(x, x @ np.array([1.0, -2.0, 0.5]), 1e-9).coef, abs=1e-4)
