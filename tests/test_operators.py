"""Hand-made frames, invariants and kernels."""

from __future__ import annotations

import ast
import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.functions import stats
from tidecast.operators import clean, combine, factors, features, interpret, kernels, metrics, panel, runner, windows
from tidecast.operators._base import PanelError
from tidecast.operators.tests_stat import adjust_pvalues, dm_test, model_confidence_set_kernel
from tidecast.sources import loaders, sinks
from tidecast.streaming import online

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_outside_imports_llm():
    for p in (ROOT / "tidecast").rglob("*.py"):
        if "llm" in p.parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), p


def frame(spark, values, name="x"):
    rows = [(f"2000-{i + 1:02d}-01" if i < 12 else f"2001-{i - 11:02d}-01", v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"d string, {name} double").select(F.to_date("d").alias("date"), name)


def values(df, c):
    return [r[c] for r in df.orderBy("date").collect()]


def test_panel_contract(spark):
    df = frame(spark, [1.0, None, 3.0])
    assert panel.validate_panel(df) is df
    with pytest.raises(PanelError):
        panel.validate_panel(df.union(df))
    with pytest.raises(PanelError):
        panel.validate_panel(df.limit(0))
    with pytest.raises(PanelError):
        panel.as_panel(df.select("date", F.lit("oops").alias("x")))
    assert values(panel.as_panel(frame(spark, [float("nan"), 2.0])), "x") == [None, 2.0]


def test_missing_values_guard_windows(spark):
    df = frame(spark, [1.0, 2.0, None, 4.0, 5.0, 6.0])
    assert values(features.rolling_mean(df, ["x"], (2,)), "x_mean2") == [None, 1.5, None, None, 4.5, 5.5]
    assert values(features.marx(df, ["x"], 2), "x_marx2") == [None, None, 1.5, None, None, 4.5]
    assert values(clean.linear_interpolate_clean(df, ["x"]), "x") == [1, 2, 3, 4, 5, 6]
    assert values(features.cumsum_features(df, columns=["x"]), "x_cumsum") == [1, 3, None, 7, 12, 18]


def test_log_code_nulls_the_series(spark):
    assert values(clean.apply_tcode_transform(frame(spark, [1.0, 0.0, 2.0]), {"x": 5}), "x") == [None] * 3
    got = values(clean.apply_tcode_transform(frame(spark, [1.0, math.e, math.e**3]), {"x": 6}), "x")
    assert got[:2] == [None, None] and got[2] == pytest.approx(1.0)


def test_zero_spread(spark):
    df = frame(spark, [2.0, 2.0, 2.0])
    assert values(clean.iqr_outlier_clean(df, ["x"], 0.1), "x") == [2.0] * 3
    with pytest.raises(Exception, match="zero scale"):
        clean.standardize_clean(df, ["x"]).collect()


def test_savitzky_golay_keeps_a_parabola(spark):
    y = [0.5 * i * i - i + 2.0 for i in range(9)]
    assert values(features.savitzky_golay_features(frame(spark, y), ["x"]), "x_sg") == pytest.approx(y)


def test_folds_look_back_only():
    for name in ("last_block", "poos", "expanding", "rolling_blocks", "blocked_kfold"):
        for a, b, c, d in windows.make_splitter(name, 60, embargo=2):
            assert 0 <= a < b <= c - 2 and c < d <= 60


def test_vintages_as_of(spark):
    v = spark.sql("SELECT DATE'2000-01-15' vintage, DATE'2000-01-01' date, 'a' series, 1.0D value UNION ALL SELECT DATE'2000-02-15', DATE'2000-01-01', 'a', 2.0D")
    o = spark.sql("SELECT explode(array(DATE'2000-01-01', DATE'2000-01-15', DATE'2000-03-01')) origin")
    assert sorted((str(r["origin"]), r["value"]) for r in panel.snapshots(v, o).collect()) == [("2000-01-15", 1.0), ("2000-03-01", 2.0)]
    assert panel.actuals(v, "first_release").first()["value"] == 1.0


def long_series(spark, n=80, seed=0):
    rng = np.random.default_rng(seed)
    y = np.cumsum(rng.normal(size=n)) + 50
    return spark.range(n).select(F.lit("t").alias("target"), F.add_months(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias("date"), F.get(F.array(*[F.lit(float(v)) for v in y]), F.col("id").cast("int")).alias("y"))


def test_the_future_does_not_leak(spark):
    base = long_series(spark)
    moved = base.withColumn("y", F.when(F.col("date") >= "2005-06-01", F.col("y") + 1000).otherwise(F.col("y")))
    arms = [runner.Arm("ridge", "ridge"), runner.Arm("path", "ols", {}, "path_average"), runner.Arm("rec", "ols", {}, "recursive"), runner.Arm("ar_bic", "ar_bic")]
    run = lambda d: sorted((r["arm"], r["origin_pos"], round(r["prediction"], 8)) for r in runner.run_arms(d, arms, (3,), 40).where("origin < '2005-06-01'").collect())
    assert run(base) == run(moved) and len(run(base)) > 60


def test_chunks_do_not_matter_and_failures_stay_in_rows(spark):
    arms = [runner.Arm("ols", "ols"), runner.Arm("gone", "no_such_model")]
    a, b = (runner.run_arms(long_series(spark), arms, (1,), 40, chunk=c) for c in (4, 64))
    key = lambda d: sorted((r["arm"], r["origin_pos"], r["prediction"] or 0.0) for r in d.collect())
    assert key(a) == key(b)
    assert "no_such_model" in runner.failed_cells(a).first()["error"]


SMALL = {
    "lstm": {"learning_rate": 0.02, "hidden_size": 8}, "gru": {"learning_rate": 0.02, "hidden_size": 8}, "transformer": {"learning_rate": 0.02, "hidden_size": 8},
    "hemisphere_nn": {"n_estimators": 4, "neurons": 16, "learning_rate": 0.01, "max_epochs": 80, "patience": 40},
    "density_hnn": {"n_estimators": 4, "prior_estimators": 2, "neurons": 16, "learning_rate": 0.01, "max_epochs": 80, "patience": 40},
    "booging": {"B": 5, "inner_n_estimators": 60}, "xgboost": {"n_estimators": 60}, "lightgbm": {"n_estimators": 60, "min_child_samples": 5}, "catboost": {"n_estimators": 100},
    "lgb_plus": {"n_steps": 80, "learning_rate": 0.1}, "lgba_plus": {"n_cycles": 10}, "svr": {"epsilon": 0.01}, "nu_svr": {"C": 5.0}, "linear_svr": {"C": 10.0},
    "stacking": {"models": ("ridge", "pcr")},
}


@pytest.mark.parametrize("name", [n for n, m in kernels.MODELS.items() if m.kind == "supervised"])
def test_supervised_kernels_learn(name):
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 1, (80, 4))
    y = 1 + x @ np.array([2.0, 1.0, 0.5, 0.25]) + 0.01 * rng.normal(size=80)
    if kernels.get_model(name).family == "aggregation":  # weights without an intercept, on the simplex by default
        y = x @ np.array([0.55, 0.25, 0.15, 0.05]) + 0.01 * rng.normal(size=80)
    small = SMALL.get(name, {"alpha": 1e-3} if "alpha" in kernels.get_model(name).search else {})
    p = kernels.get_model(name).fit(x[:60], y[:60], **small)(x[60:])
    assert p.shape == (20,) and np.isfinite(p).all()
    assert ((p - y[60:]) ** 2).mean() < (1.3 if name in ("shrink_to_target_ridge", "midas_beta", "restricted_midas", "midas_almon", "midas_step", "random_walk_ridge") else 0.6) * y[60:].var() + 0.2


@pytest.mark.parametrize("name", [n for n, m in kernels.MODELS.items() if m.kind == "target"])
def test_series_kernels_follow_a_line(name):
    y = np.arange(60.0) + np.sin(np.arange(60)) * 0.01
    p = kernels.get_model(name).fit(y, 3)
    assert p.shape == (3,) and np.isfinite(p).all()
    if name in ("random_walk_drift", "ar_bic", "holt_winters"):
        assert p == pytest.approx([60, 61, 62], abs=1.0)


def test_linear_kernels_against_closed_forms():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(50, 3)), rng.normal(size=50)
    xc, yc = x - x.mean(0), y - y.mean()
    assert kernels.ridge(x, y, 2.0).coef == pytest.approx(np.linalg.solve(xc.T @ xc + 2 * np.eye(3), xc.T @ yc))
    b = kernels.lasso(x, y, 0.05).coef
    g = xc.T @ (yc - xc @ b) / 50
    assert np.all(np.abs(g) <= 0.05 + 1e-8) and g[b != 0] == pytest.approx(0.05 * np.sign(b[b != 0]), abs=1e-7)
    assert kernels.pls(x, y, 3)(x) == pytest.approx(kernels.ols(x, y)(x))
    assert kernels.pcr(x, y, 3)(x) == pytest.approx(kernels.ols(x, y)(x))
    assert kernels.csr(x, y, 3)(x) == pytest.approx(kernels.ols(x, y)(x))
    assert kernels.nonneg_ridge(x, y, 1.0).coef.min() >= 0
    w = interpret.ols_attention_weights(x, x)
    assert w @ y == pytest.approx(kernels.ols(x, y)(x))


def test_vector_models():
    rng = np.random.default_rng(3)
    z = np.zeros((300, 2))
    for t in range(1, 300):
        z[t] = np.array([[0.5, 0.2], [0.0, 0.4]]) @ z[t - 1] + rng.normal(size=2)
    assert kernels.var_fit(z, 1)[1] == pytest.approx(np.array([[0.5, 0.2], [0.0, 0.4]]), abs=0.15)
    assert kernels.var_roots(z, 1).max() < 1
    f = kernels.fevd(z, 1, 6)
    assert f.sum(2) == pytest.approx(1)
    assert kernels.impulse_responses(z, 1, 3, False)[1] == pytest.approx(kernels.var_fit(z, 1)[1])


def test_distributions():
    assert stats.norm_cdf(1.959963984540054) == pytest.approx(0.975)
    assert stats.norm_ppf(0.975) == pytest.approx(1.959963984540054)
    assert stats.chi2_sf(5.991464547107979, 2) == pytest.approx(0.05)
    assert stats.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05)
    assert stats.f_sf(4.964602743730711, 1, 10) == pytest.approx(0.05)


def test_weights_of_combinations():
    rng = np.random.default_rng(4)
    f = rng.normal(size=(200, 3))
    y = f @ np.array([0.7, 0.3, 0.0])
    assert combine.constrained_ls_weights(f, y) == pytest.approx([0.7, 0.3, 0.0], abs=1e-4)
    assert combine.regression_weights(f, y)[1] == pytest.approx([0.7, 0.3, 0.0])
    e = rng.normal(size=(4000, 2)) * np.array([1.0, 2.0])
    assert combine.min_variance_weights(e) == pytest.approx([0.8, 0.2], abs=0.05)


def test_confidence_set_drops_the_bad_model():
    rng = np.random.default_rng(5)
    losses = rng.normal(size=(200, 3)) ** 2 + np.array([0.0, 0.0, 2.0])
    p, out = model_confidence_set_kernel(losses, 199, 4, 0)
    assert p[2] < 0.05 and out[2] == 0 and p[:2].max() == 1.0


def test_identical_forecasts_have_no_statistic(spark):
    rows = spark.range(20).select(F.lit("t").alias("target"), F.lit(1).alias("horizon"), F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias("date"), (F.col("id") * 1.0).alias("actual"), F.lit(3.0).alias("prediction"))
    f = rows.withColumn("model", F.lit("a")).union(rows.withColumn("model", F.lit("b")))
    r = dm_test(f, "a").first()
    assert r["statistic"] is None and r["p_value"] is None


def test_p_values_ignore_missing(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, None), (4, 0.03)], "i int, p_value double")
    got = {r["i"]: r["p_adjusted"] for r in adjust_pvalues(df, "holm").collect()}
    assert got[3] is None and got[1] == pytest.approx(0.03) and got[2] == got[4] == pytest.approx(0.06)


def test_ranks_share_ties_and_skip_missing(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0), (1, "c", 2.0), (1, "d", None)], "horizon int, model string, mse double")
    assert {r["model"]: r["rank"] for r in metrics.rank_forecasts(df).collect()} == {"a": 1, "b": 1, "c": 3, "d": None}


def test_em_imputation_recovers_a_factor():
    rng = np.random.default_rng(6)
    x = np.outer(rng.normal(size=120), [1.0, -1.0, 0.5, 2.0]) + 0.01 * rng.normal(size=(120, 4))
    holes = x.copy()
    holes[::7, 1] = np.nan
    assert np.abs(factors.em_impute(holes, 1)[::7, 1] - x[::7, 1]).max() < 0.2
    assert np.isfinite(factors.em_impute(holes, 1)).all()


def test_filters_add_up():
    y = np.arange(48.0) + np.tile([1, -1, 0, 0], 12)
    assert factors.stl_additive(y, 4).sum(1) == pytest.approx(y)
    assert factors.hp_trend(np.arange(30.0)) == pytest.approx(np.arange(30.0), abs=1e-6)
    low = np.array([1.0, 2.0, 4.0])
    assert factors.chow_lin(low, np.arange(9.0)).reshape(3, 3).mean(1) == pytest.approx(low)


def test_shapley_adds_up():
    v = lambda s: sum({0: 1.0, 1: 2.0, 2: 4.0}[i] for i in s) + (3.0 if {0, 1} <= s else 0.0)
    exact = interpret.exact_shapley(v, 3)
    assert exact == pytest.approx([2.5, 3.5, 4.0]) and interpret.permutation_shapley(v, 3, 50).sum() == pytest.approx(10.0)


def test_macro_csv_both_layouts(spark, tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_text(",5,2\nsasdate,X,Y\n1/1/2000,1.5,2\n2/1/2000,,3\n")
    b.write_text("sasdate,X,Y\nTransform:,5,2\n1/1/2000,1.5,2\n2/1/2000,,3\n")
    for p in (a, b):
        got = loaders.load_macro_csv(spark, str(p))
        assert got.metadata["tcodes"] == {"X": 5, "Y": 2}
        assert [tuple(r)[1:] for r in got.panel.orderBy("date").collect()] == [(1.5, 2.0), (None, 3.0)]


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("t", "a", 1, 0.5), ("t", "b", 1, 0.7)], "target string, arm string, horizon int, x double")
    sinks.append_checkpoint(df, str(tmp_path / "ck"))
    cells = df.select("target", "arm", "horizon").union(spark.createDataFrame([("t", "c", 1)], "target string, arm string, horizon int"))
    assert [r["arm"] for r in sinks.pending_cells(cells, str(tmp_path / "ck")).collect()] == ["c"]
    made = sinks.write_artifacts({"t": df}, str(tmp_path / "out"), ("parquet", "csv"))
    assert sinks.read_manifest(spark, str(tmp_path / "out")) == made
    assert "| t | a | 1 | 0.500 |" in sinks.markdown_table(df.orderBy("arm")) and "0.700" in sinks.latex_table(df) and "<td>b</td>" in sinks.html_table(df)


def test_streamed_panel_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "e"))
    s = online.tumbling_panel(online.read_events(spark, str(tmp_path / "e")))
    got = online.drain(s, str(tmp_path / "c"), "complete")
    want = online.tumbling_panel(events)
    key = lambda d: sorted((r["start"], r["event_type"], r["n"], round(r["total"], 6)) for r in d.collect())
    assert key(got) == key(want)


def test_every_supplier_is_imputed(spark, tmp_path):
    import pandas as pd

    from tidecast.operators.factors import em_impute
    from tidecast.plans.bases import ship_panel
    from tidecast.plans.registry import QUERIES

    rng = np.random.default_rng(5)
    rows = [(k, f"2000-{m:02d}-15", float(rng.uniform(1e6, 2e6)), 0.1) for k in range(1, 15) for m in range(1, 13) if (k + m) % 9]
    made = spark.createDataFrame(rows, "l_suppkey long, day string, l_extendedprice double, l_discount double")
    made.selectExpr("l_suppkey", "CAST(day AS TIMESTAMP_NTZ) AS l_shipdate", "l_extendedprice", "l_discount").write.parquet(f"{tmp_path}/lineitem.parquet")
    wide = ship_panel(spark, str(tmp_path)).toPandas().pivot(index="date", columns="series", values="value").sort_index()
    want = {}
    for first in (1, 7, 13):
        names = [f"s{k}" for k in range(first, min(first + 6, 15))]
        part = wide[names]
        full = em_impute(part.to_numpy(float), 2)
        want |= {(n, d): full[i, j] for i, d in enumerate(part.index) for j, n in enumerate(names)}
    got = {(r["series"], r["date"]): r["value"] for r in QUERIES["impute_em_factor"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and len({n for n, _ in got}) == 14
    for at, value in want.items():
        assert (got[at] is None) == bool(pd.isna(value)) and (got[at] is None or abs(got[at] - value) < 1e-5)  # results are rounded


WHOLE_PANEL = ["decision_tree", "random_forest", "extra_trees", "gradient_boosting", "quantile_regression_forest", "macro_random_forest", "mars", "nn"]


@pytest.fixture(scope="module")
def short_orders(spark, tmp_path_factory):
    """65 months of orders, one order of each priority a month."""
    to, rng = str(tmp_path_factory.mktemp("orders")), np.random.default_rng(8)
    rows = [(f"{1996 + m // 12}-{m % 12 + 1:02d}-10", f"{p}-X", float(rng.uniform(1e6, 3e6))) for m in range(65) for p in range(1, 6)]
    made = spark.createDataFrame(rows, "day string, o_orderpriority string, o_totalprice double")
    made.selectExpr("CAST(day AS TIMESTAMP_NTZ) AS o_orderdate", "o_orderpriority", "o_totalprice").write.parquet(f"{to}/orders.parquet")
    return to


@pytest.mark.parametrize("name", [f"model_{n}" for n in WHOLE_PANEL] + ["model_ucsv_path", "model_theta_method_path"])
def test_models_cover_every_series_and_origin(spark, short_orders, name):
    from tidecast.plans.registry import QUERIES

    ends = 65 - (3 if name.endswith("_path") else 1)
    rows = QUERIES[name](spark, short_orders).collect()
    assert sorted((r["target"], r["origin_pos"]) for r in rows) == [(f"p{i}", o) for i in range(1, 6) for o in range(60, ends)]
    assert all(r["error"] is None for r in rows)


def test_albama_covers_every_series(spark, short_orders):
    from tidecast.plans.registry import QUERIES

    rows = QUERIES["filter_albama"](spark, short_orders).collect()
    assert {r["series"] for r in rows} == {f"p{i}" for i in range(1, 6)} and len(rows) == 325
