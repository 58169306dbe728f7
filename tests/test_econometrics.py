"""Kernels of unit roots, causality, volatility, selection and search."""

from __future__ import annotations

import numpy as np
import pytest

from tidecast.operators import econometrics as E
from tidecast.operators import select
from tidecast.operators.runner import Arm
from tidecast.plans import config

RNG = np.random.default_rng(0)
WALK, NOISE = np.cumsum(RNG.normal(size=300)), RNG.normal(size=300)
NOISE[0] = 0.0  # local-to-unity detrending leans on the first value


def test_unit_roots_tell_walks_from_noise():
    for f in (E.adf, E.phillips_perron, E.dfgls, E.zivot_andrews):
        assert f(NOISE)["statistic"] < -5 < f(WALK)["statistic"]
    assert E.kpss(NOISE)["statistic"] < 0.463 < E.kpss(WALK)["statistic"]
    assert E.ndiffs(WALK)["ndiffs"] == 1 and E.ndiffs(NOISE)["ndiffs"] == 0
    season = np.tile(np.arange(12.0), 20) + 0.1 * RNG.normal(size=240)
    assert E.nsdiffs(season)["nsdiffs"] == 1 and E.nsdiffs(NOISE[:240])["nsdiffs"] == 0


def test_partial_autocorrelation_of_ar1():
    y = np.zeros(4000)
    for t in range(1, 4000):
        y[t] = 0.6 * y[t - 1] + RNG.normal()
    p = E.pacf(y, 3)
    assert p[1] == pytest.approx(0.6, abs=0.05) and np.abs(p[2:]).max() < 0.06


def test_covariances():
    x, y = RNG.normal(size=(200, 2)), RNG.normal(size=200)
    b, v = E.hac_covariance(x, y, 0)
    b0, v0 = E.vcov_hc(x, y, "HC0")
    assert b == pytest.approx(b0) and v == pytest.approx(v0)
    assert np.all(np.diag(E.vcov_hc(x, y, "HC3")[1]) >= np.diag(v0))
    het = x[:, 0] * RNG.normal(size=200) * 3
    assert E.breusch_pagan(x**2, het)[1] < 0.01 < E.breusch_pagan(x, y)[1]


def test_cointegration_and_causality():
    x = np.cumsum(RNG.normal(size=400))
    y = 2 * x + RNG.normal(size=400)
    assert E.engle_granger(y, x[:, None])["statistic"] < -5 and E.phillips_ouliaris(y, x[:, None])["statistic"] < -5
    trace, top = E.johansen(np.column_stack([x, y]))
    assert trace[0] > 20 > trace[1] and trace[1] == pytest.approx(top[1])
    z = np.zeros((400, 2))
    for t in range(1, 400):
        z[t] = [0.5 * z[t - 1, 0] + 0.5 * z[t - 1, 1], 0.3 * z[t - 1, 1]] + RNG.normal(size=2)
    assert E.granger_causality(z, 0, [1])[1] < 0.001 < E.granger_causality(z, 1, [0])[1]
    assert E.instantaneous_causality(z, 0, 1)[1] > 0.001
    assert E.var_select_order(z)["bic"] == 1
    assert E.generalized_irf(z, 1, 2).shape == (3, 2, 2)


def test_density_and_loss_tests():
    u = RNG.random(400)
    assert E.berkowitz(u)[1] > 0.01 > E.berkowitz(u**2)[1]
    y = RNG.normal(size=500)
    assert E.dynamic_quantile(y, np.full(500, -1.645) + 0.01 * RNG.normal(size=500))[1] > 0.01
    d = RNG.normal(size=300)
    ones = np.ones((300, 1))
    assert E.giacomini_white(d, ones)[1] > 0.001 > E.giacomini_white(d + 1, ones)[1]
    h = RNG.normal(size=(200, 3))
    assert E.multi_horizon_spa(h + 1, "uspa")[1] < 0.05 and E.multi_horizon_spa(h + 1, "aspa")[1] < 0.05
    p = E.romano_wolf(np.column_stack([h[:, 0] + 1, h[:, 1:]]), 199)
    assert p[0] < 0.05 < p[1:].max()


def test_volatility():
    y = RNG.normal(size=400)
    _, h = E.egarch_path(y)
    assert np.exp(h).mean() == pytest.approx(y.var(), rel=0.3)
    var, es = E.risk_forecast(0.0, np.array([1.0, 4.0]))
    assert var == pytest.approx([1.645, 3.290], abs=1e-3) and np.all(es > var)
    e, v = E.news_impact_curve(0.1, 0.1, 0.8, 1.0, 0.2)
    assert v[0] > v[-1] and e[50] == pytest.approx(0)
    roll = E.garch_roll(y, 300, refit=50)
    assert len(roll) == 100 and roll["hit"].mean() < 0.2


def smoothed_walk(y, noise, step):
    """Smoothed mean of a random walk seen with noise, by its normal equations."""
    d = np.diff(np.eye(len(y)), axis=0)
    return np.linalg.solve(np.eye(len(y)) / noise + d.T @ d / step, y / noise)


@pytest.mark.parametrize("seed", range(3))
def test_trend_draws_follow_the_series(seed):
    rng = np.random.default_rng(seed)
    y = np.cumsum(0.3 * rng.normal(size=80)) + 0.5 * rng.normal(size=80)
    x = E.ucsv(y, 150, 50)
    assert np.isfinite(x).all() and np.corrcoef(x, smoothed_walk(y, 0.25, 0.09))[0, 1] > 0.95


@pytest.mark.parametrize("f", [E.star_forecast, E.auto_arima, E.stlf])
def test_paths(f):
    y = np.tile(np.arange(12.0), 8) + 0.1 * RNG.normal(size=96)
    p = f(y, 4)
    assert p.shape == (4,) and np.isfinite(p).all()


def test_selections_find_the_predictors():
    x = RNG.normal(size=(200, 8))
    y = x[:, 2] * 2 - x[:, 5] + 0.1 * RNG.normal(size=200)
    for f in (select.lasso_selection, select.lasso_path_selection, select.rfe_selection, select.genetic_selection):
        assert set(f(x, y, 2).tolist()) == {2, 5}
    assert set(select.stability_selection(x, y)[0]) >= {2, 5}
    assert 2 in select.boruta_selection(x, y, 4)
    d = select.sliced_inverse_regression(x, y, 1)[:, 0]
    assert set(np.argsort(-np.abs(d))[:2].tolist()) == {2, 5}
    assert select.nystroem(x, 5).shape == (200, 5)
    assert (select.sparse_components(x, 2, 3) != 0).sum(0).max() <= 3


def test_searches_reach_the_minimum():
    space = {"a": select.uniform(-1, 1), "b": select.log_uniform(1e-3, 1.0), "c": select.choice(("x", "y")), "d": select.randint(0, 4)}
    loss = lambda p: (p["a"] - 0.5) ** 2 + (np.log10(p["b"]) + 1) ** 2 + (p["c"] == "y") + abs(p["d"] - 2)
    first = min(loss(p) for p in select.random_candidates(space, 5))
    for search in (select.bayesian_search, select.genetic_search):
        best, trials = search(loss, space)
        assert loss(best) <= first and loss(best) == min(v for _, v in trials)


def test_config_nests():
    with config.use_config(random_seed=3):
        assert config.get_option("random_seed") == 3
    assert config.get_config() == config.reset_config()


def test_result_store(spark, tmp_path):
    s = config.ResultStore(spark, str(tmp_path / "store"))
    a, b = (config.cell_digest(Arm("m", "ridge"), "t", h, "v1") for h in (1, 2))
    s.write(spark.createDataFrame([(1, 2.0)], "origin_pos int, prediction double"), a, {"arm": "m"})
    assert s.load(a).first()["prediction"] == 2.0 and s.summary().first()["n_rows"] == 1
    assert [r["digest"] for r in s.pending(spark.createDataFrame([(a,), (b,)], "digest string")).collect()] == [b]
