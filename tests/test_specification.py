"""Specifications, searches, studies, attribution, suites and reports."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidecast.operators import clean, features, joint_tests, kernels, panel, runner, searching, specs, study, suites, windows
from tidecast.operators import interpret_models as im
from tidecast.operators.interpret import exact_shapley
from tidecast.plans.bases import P, forecasts, order_long, order_panel
from tidecast.sources import loaders, reporting

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def wide(spark):
    return spark.createDataFrame(order_panel(spark, SF).dropna().toPandas())


@pytest.fixture(scope="module")
def fc(spark):
    return spark.createDataFrame(forecasts(spark, SF).where("prediction IS NOT NULL AND actual IS NOT NULL").toPandas())


def long_of(spark):
    return order_long(spark, SF).select(F.col("series").alias("target"), "date", F.col("value").alias("y"))


# Recipes.


def test_recipe_is_fitted_once_and_applied_to_other_rows(spark, wide):
    r = specs.feature_spec(target="p1", horizon=1, predictors=["p2", "p3"], lags=(0, 1), rolling_windows=3, pca_components=2, pca_columns=["p2", "p3", "p4"])
    cut = wide.where("date < '1998-01-01'")
    built = r.fit(cut)
    assert built.to_metadata()["feature_spec"]["horizons"] == (1,) and len(built.pca_state["loadings"]) == 3
    got = built.transform(wide)
    x = cut.select("p2", "p3", "p4").toPandas().to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    _, _, v = np.linalg.svd(z, full_matrices=False)
    want = ((wide.orderBy("date").select("p2", "p3", "p4").toPandas().to_numpy() - x.mean(0)) / x.std(0)) @ v[:2].T
    made = got.frame.orderBy("date").select("pc1", "pc2").toPandas().to_numpy()
    assert np.abs(made) == pytest.approx(np.abs(want[2:-1]), abs=1e-8)
    assert got.X.columns[1:] == list(got.features) and got.frame.count() == wide.count() - 3
    with pytest.raises(ValueError):
        specs.feature_spec(target="nope").fit(wide)
    with pytest.raises(ValueError):
        specs.feature_spec()


def test_recipe_steps_and_average_targets(wide):
    r = specs.feature_spec(targets=["p1"], horizons=(1, 2), lags=(0,), add_time=True, steps=[features.marx_step(columns=["p2"], max_lag=2)], target_transform="change", target_mode="average", drop_missing=False)
    out = r.fit_transform(wide)
    assert {"p2_marx1", "p2_marx2"} <= set(out.features) and len(out.targets) == 2


def test_blocks_of_components(wide):
    a = specs.group_pca(wide, {"left": ["p2", "p3"], "right": ["p4", "p5"]}, 1, fit_policy="full")
    assert a.columns == ["date", "left_pc1", "right_pc1"] and a.dropna().count() == wide.count()
    b = specs.pca_then_lags(wide, ["p2", "p3"], 1, (0, 2), fit_policy="full").orderBy("date").toPandas()
    assert b["pc1_lag2"].to_numpy()[2:] == pytest.approx(b["pc1"].to_numpy()[:-2])
    assert specs.lags_then_pca(wide, ["p2"], (0, 1, 2), 1, fit_policy="full").dropna().count() == wide.count() - 2
    assert specs.moving_average_pca_lags(wide, ["p2"], 3, 1, (1,), fit_policy="full").dropna().count() == wide.count() - 3
    m = specs.feature_matrix(wide, "X-MARX-F", ["p2", "p3"], lags=(0, 1), max_lag=2, n_factors=1, fit_policy="full")
    assert {"X_p2", "X_p3_lag1", "MARX_p2_marx2", "F_f1"} <= set(m.columns)
    with pytest.raises(ValueError):
        specs.feature_matrix(wide, "Y")
    pls = specs.partial_least_squares_features(wide.select("date", "p2", "p3", (F.col("p2") * 2).alias("t")), "t", None, 1)
    assert abs(pls.dropna().join(wide, "date").agg(F.corr("pls1", "p2")).first()[0]) > 0.5
    with_step = features.compose_features(wide, [specs.sparse_pca_chen_rohe_step(columns=["p2", "p3", "p4"], n_components=1)])
    assert "sca1" in with_step.columns


def test_selection_by_name(wide):
    frame = wide.withColumn("t", F.col("p2") * 3 + F.col("p4"))
    for method in ("lasso", "rfe", "correlation"):
        got = specs.select_features(frame, "t", ["p2", "p3", "p4", "p5"], 2, method)
        assert "p2" in got.selected and len(got.selected) == 2 and set(got.scores) == set(got.selected)
    assert len(specs.select_features(frame, None, list(P), 0.4, "variance").selected) == 2
    assert specs.normalize_feature_selection_method("RFE") == "recursive_feature_elimination" and not specs.feature_selection_requires_target("variance")
    for bad in (lambda: specs.normalize_feature_selection_method("x"), lambda: specs.select_features(frame, None, method="lasso")):
        with pytest.raises(ValueError):
            bad()


def test_sparse_components_by_criterion():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 6))
    s = specs.normalize_sparse_ic_search({"criterion": "bic", "grid": {"keep": [1, 6]}}, ["keep", "n_components"])
    got = specs.select_sparse_ic_params(x, x[:, 0] * 0 + rng.normal(size=120), s, {"n_components": 1})
    assert got["params"] == {"n_components": 1, "keep": 1} and specs.sparse_ic_metadata(got)["n_trials"] == 2
    with pytest.raises(ValueError):
        specs.normalize_sparse_ic_search({"grid": {"nope": [1]}}, ["keep"])


# Searches.


def test_folds_of_named_splitters():
    assert searching.resolve_validation_splitter(80, searching.recursive_threefold()) == [(0, 20, 20, 40), (0, 40, 40, 60), (0, 60, 60, 80)]
    assert searching.resolve_validation_splitter(10, searching.explicit_folds([4, 7])) == [(0, 4, 4, 7), (0, 7, 7, 10)]
    assert searching.resolve_validation_splitter(6, searching.explicit_folds([4], "expanding")) == [(0, 4, 4, 5), (0, 5, 5, 6)]
    with pytest.raises(searching.SearchError):
        searching.resolve_validation_splitter(10, "nope")


@pytest.mark.parametrize("method", ["grid", "random", "custom", "bayesian", "genetic"])
def test_search_finds_the_best_of_its_trials(spark, method):
    from tidecast.operators.select import log_uniform

    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3))
    y = x @ np.array([1.0, 2.0, 0.0]) + 0.1 * rng.normal(size=60)
    frame = spark.createDataFrame(pd.DataFrame({"date": pd.date_range("2000-01-01", periods=60).date, "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y}))
    options = {
        "grid": {}, "random": {"n_iter": 2}, "custom": {"custom_func": lambda s: [{"alpha": 0.5}, {"alpha": 50.0}, {"alpha": "x"}]},
        "bayesian": {"n_iter": 5, "param_grid": {}, "param_distributions": {"alpha": log_uniform(1e-3, 1e3)}},
        "genetic": {"population_size": 4, "generations": 2, "param_grid": {}, "param_distributions": {"alpha": log_uniform(1e-3, 1e3)}},
    }[method]
    spec = searching.search_spec("ridge", method=method, validation_splitter=searching.recursive_threefold(), **options)
    got = searching.run_search(frame, "ridge", ["a", "b", "c"], "y", spec)
    folds = searching.resolve_validation_splitter(60, searching.recursive_threefold())
    for t in got.trials:
        if t.error is None:
            assert t.score == pytest.approx(searching.evaluate_candidate("ridge", x, y, folds, t.params))
    assert got.best_score == min(t.score for t in got.trials if t.error is None)
    assert json.loads(got.to_json())["n_trials"] == len(got.trials) == got.to_frame(spark).count()
    if method == "custom":
        assert got.best_params == {"alpha": 0.5} and got.trials[2].error


def test_one_fit_serves_all_numbers_of_components():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4))
    y = x[:, 0] + 0.1 * rng.normal(size=60)
    folds = [(0, 30, 30, 45), (0, 45, 45, 60)]
    got = searching.evaluate_candidate_group(searching.PREFIX_SEARCH["pcr"], x, y, folds, [1, 2, 4])
    for k, v in got.items():
        assert v == pytest.approx(searching.evaluate_candidate("pcr", x, y, folds, {"n_components": k}))


def test_registry_and_kept_fits(spark, tmp_path):
    assert searching.list_model_specs(spark, family="linear").count() > 5 and searching.model_search_space("ridge")["alpha"]
    assert {p.name for p in searching.describe_model("ridge")} >= {"alpha", "standardize"}
    assert searching.list_model_ensemble_specs(spark).count() >= 6 and searching.model_ensemble_search_space("bagging")
    with pytest.raises(KeyError):
        searching.get_model_ensemble("nope")
    rng = np.random.default_rng(3)
    x = pd.DataFrame(rng.normal(size=(50, 2)), columns=["a", "b"])
    fit = searching.fit_estimator("ridge", x, x["a"] * 2 + 1, alpha=1e-6)
    assert fit.predict(x) == pytest.approx(x["a"] * 2 + 1, abs=1e-3) and fit.summary()["active"] >= 1
    searching.save_fit(spark, fit, str(tmp_path / "m"))
    assert searching.load_fit(spark, str(tmp_path / "m")).predict(x) == pytest.approx(fit.predict(x))
    knn = searching.fit_estimator("knn", x, x["a"])
    with pytest.raises(ValueError):
        searching.save_fit(spark, knn, str(tmp_path / "k"))
    searching.save_fit(spark, knn, str(tmp_path / "k"), x.to_numpy(), x["a"].to_numpy())
    assert searching.load_fit(spark, str(tmp_path / "k")).predict(x) == pytest.approx(knn.predict(x))
    scored = fit.transform(spark.createDataFrame(x)).toPandas()
    assert scored["prediction"].to_numpy() == pytest.approx(fit.predict(scored))
    assert searching.resolve_feature_count("sqrt", 16) == 4 and searching.binary_feature_mask([[0, 1.5], [1, 2.5], [0, 3]]).tolist() == [True, False]
    made = searching.custom_model_ensemble("pair", lambda a, b, alpha=1.0: kernels.ridge(a, b, alpha), alpha=0.1)
    assert made.fit(x.to_numpy(), x["a"].to_numpy())(x.to_numpy()).shape == (50,)
    del kernels.MODELS["pair"], searching.ENSEMBLES["pair"]


# Studies.


def make_spec(spark, **o):
    arms = [runner.Arm("rw", "naive"), runner.Arm("ridge", "ridge"), runner.Arm("avg", "ols", {}, "direct_average")]
    evaluation = study.Evaluation("rw", tests=("dm", "cw", "mcs"), subsamples={"late": study.SubsampleWindow("2000-01-01")})
    return study.pipeline_spec(data=long_of(spark).where("y IS NOT NULL"), targets=[study.TargetSpec(p, "level") for p in P[:2]], horizons=(1, 2), arms=arms, evaluation=evaluation, combinations=[study.CombinationContender("both", "mean", ("rw", "ridge"))], first_origin=60, **o)


def test_study_and_its_score_from_the_checkpoint(spark, tmp_path):
    spec = make_spec(spark, checkpoint_dir=str(tmp_path / "c"))
    r = study.run_study(spec)
    key = lambda d: sorted((x["target"], x["horizon"], x["model"], round(x["rmse"], 9)) for x in d.collect())
    whole = key(r.accuracy)
    assert {m for _, _, m, _ in whole} == {"rw", "ridge", "avg", "both"} and r.failed_cells.count() == 0
    assert r.to_frame("late").count() == len(whole) and r.significance.where("p_adjusted < p_value").count() == 0 and r.mcs.count() > 0
    again = study.rescore(spark, str(tmp_path / "c"), spec)
    assert key(again.accuracy) == whole and again.provenance["rescored_from"]
    other = study.with_evaluation(make_spec(spark, step=3), benchmark="ridge")
    with pytest.raises(ValueError):
        study.rescore(spark, str(tmp_path / "c"), other)
    assert study.rescore(spark, str(tmp_path / "c"), other, allow_stale=True).accuracy.where("is_benchmark").first()["model"] == "ridge"
    told = study.interpret_pipeline(r, ("linear_coef", "permutation_importance"), ("ridge",))
    assert told["ridge"]["linear_coef"].count() == 6
    assert reporting.interpretation_table(told).count() == 12


def test_average_policies_are_held_against_averages(spark):
    rows = [("t", str(d)[:10], float(v)) for d, v in zip(pd.date_range("2000-01-01", periods=30, freq="MS"), np.arange(30.0))]
    long = spark.createDataFrame(rows, "target string, date string, y double").withColumn("date", F.col("date").cast("date"))
    arms = [runner.Arm("a", "ols", {}, "direct_average", 1), runner.Arm("b", "ols", {}, "path_average", 1), runner.Arm("c", "ols", lags=1)]
    got = {(r["arm"], r["origin_pos"]): r for r in runner.run_arms(long, arms, (3,), 20, window=12).collect()}
    for (arm, o), r in got.items():
        assert r["actual"] == (o + 3 if arm == "c" else o + 2) and r["prediction"] == pytest.approx(r["actual"])
    assert len(got) == 3 * 7


def test_specifications_are_checked(spark):
    ok = {"data": long_of(spark), "targets": [study.TargetSpec("p1", "level")], "horizons": (1,), "arms": [runner.Arm("rw", "naive")], "evaluation": study.Evaluation("rw")}
    for change in ({"arms": []}, {"horizons": (0,)}, {"evaluation": study.Evaluation("x")}, {"targets": ["p1"]}, {"combinations": [study.CombinationContender("rw")]}, {"combinations": [study.CombinationContender("c", "nope")]}):
        with pytest.raises(ValueError):
            study.pipeline_spec(**{**ok, **change})
    with pytest.raises(KeyError):
        study.pipeline_spec(**{**ok, "arms": [runner.Arm("rw", "nope")]})
    assert study.resolve_target("x", {"x": 5}) == study.ResolvedTarget("x", "direct_average", "log_growth", 5, False)
    assert study.resolve_target(study.TargetSpec("x", policy="direct"), tcode=2).policy == "direct"
    assert study.auto_parallelism(3, 8) == (3, 2) and study.auto_parallelism(100, 8, 2) == (6, 1)
    m = study.SubsampleWindow(mask=(("2000-01-01", True), ("2000-02-01", False)))
    got = spark.sql("SELECT explode(array(DATE'2000-01-01', DATE'2000-02-01', DATE'2000-03-01')) date").where(m.condition()).count()
    assert got == 1 and study.subsample_provenance(study.Evaluation("rw", subsamples={"m": m}))["m"]["mask_summary"] == {"n_dates": 2, "n_true": 1}


def test_asked_densities_need_their_columns(fc):
    assert study.density_table(fc, study.Evaluation("naive")) is None and study.calibration_table(fc, study.Evaluation("naive")) is None
    for e in (study.Evaluation("naive", metrics=("crps",)), study.Evaluation("naive", metrics=("coverage_rate",))):
        with pytest.raises(ValueError):
            study.density_table(fc, e)
    dense = fc.withColumn("variance_prediction", F.lit(0.04))
    got = study.calibration_table(dense, study.Evaluation("naive", tests=("berkowitz", "pit_autocorr")))
    assert set(got.toPandas()["test"]) == {"berkowitz", "pit_autocorr"}
    assert study.density_table(dense, study.Evaluation("naive", metrics=("crps",))).where("crps > 0").count() > 0


# Attribution.


def test_loss_attribution_is_the_shapley_value(spark):
    rng = np.random.default_rng(4)
    phi, base, y = rng.normal(size=(5, 3)), 0.3, rng.normal(size=5)
    rows = [(d, f"f{j}", float(phi[d, j]), base, float(y[d])) for d in range(5) for j in range(3)]
    got = im.performance_shapley_value(spark.createDataFrame(rows, "date int, feature string, contribution double, base_value double, actual double"), local=True).collect()
    for r in got:
        d, j = r["date"], int(r["feature"][1])
        want = exact_shapley(lambda s, d=d: (y[d] - base - sum(phi[d, list(s)])) ** 2, 3)
        assert r["pbsv"] == pytest.approx(want[j])


def test_pipeline_attribution_is_the_shapley_value(spark):
    loss = [4.0, 1.0, 2.5, 3.0]
    df = spark.createDataFrame([("t", 1, f"m{i}", v) for i, v in enumerate(loss)], "target string, horizon int, model string, mse double")
    u = 4.0 - np.array(loss)
    want = exact_shapley(lambda s: u[list(s)].mean() if s else 0.0, 4)
    got = {r["pipeline"]: r["contribution"] for r in im.transformation_attribution(df).collect()}
    assert [got[f"m{i}"] for i in range(4)] == pytest.approx(want)
    one = im.transformation_attribution(df.limit(1)).first()
    assert one["contribution"] == pytest.approx(0.0)


def test_contributions_add_up(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 3))
    y = x[:, 0] * 2 + np.sin(x[:, 1])
    f = kernels.get_model("kernel_ridge").fit(x, y)
    told, base = im.shapley_rows(f, x[:4], x[:20])
    assert told.sum(1) + base == pytest.approx(f(x[:4]))
    g = kernels.get_model("nn").fit(x, y, steps=50)
    zero = np.zeros((1, 3))
    for method in ("integrated_gradients", "deep_lift"):
        part = im.gradient_attribution(g, x[:5], method, n_steps=400)
        assert part.sum(1) == pytest.approx(g(x[:5]) - g(zero), abs=0.03)
    line = kernels.ridge(x, y, 1e-9)
    assert im.gradient_shap(line, x[:3], n_samples=3) == pytest.approx(x[:3] * line.coef)
    assert im.saliency_map(line, x[:2]) == pytest.approx(np.abs(np.tile(line.coef, (2, 1))))
    s, n, *_ = im.accumulated_local_effect_2d(lambda v: v[:, 0] + v[:, 1] ** 2, x, 0, 1, 4)
    assert np.abs(s[n > 0]).max() < 0.2 and n.sum() == 60
    s, *_ = im.accumulated_local_effect_2d(lambda v: v[:, 0] * v[:, 1], x, 0, 1, 4)
    assert np.abs(s).max() > 0.5


def test_importances_find_the_column():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(150, 3))
    y = 3 * x[:, 1] + 0.1 * rng.normal(size=150)
    arm = runner.Arm("r", "ridge")
    assert np.argmax(im.lofo_importance(arm, x, y, 100)) == 1
    assert np.argmax(im.lasso_inclusion_frequency(x, y, 0.1, 20)) == 1
    assert (im.rolling_recompute(arm, x, y, 60, 30).argmax(1) == 1).all()
    b = im.bootstrap_jackknife(arm, x, y, 10)
    assert np.argmax(b["mean"]) == 1 and (b["se"] > 0).all() and (b["jackknife_se"] >= 0).all()
    tree = kernels.grow_tree(x, y, 4)
    assert im.tree_importance(tree, x, y)[1] > 0.9 and im.tree_importance(tree, x, y).sum() == pytest.approx(1)
    path = im.mrf_gtvp(x, y, 20, 5)
    assert path.shape == (150, 4) and path[:, 2].mean() == pytest.approx(3, abs=1)
    e = im.ols_attention_equivalence(x[:100], y[:100], x[100:])
    assert max(e.values()) < 1e-8
    with pytest.raises(TypeError):
        im.lstm_hidden_state(tree, x)


def test_anatomy_of_forecasts_adds_up(spark, fc):
    c = im.precompute_anatomy(long_of(spark).where("target = 'p1'"), [runner.Arm("ridge", "ridge")], (1,), 70)
    g = c.groupBy("date").agg((F.sum("contribution") + F.first("base_value") - F.first("prediction")).alias("gap")).collect()
    assert g and all(abs(r["gap"]) < 1e-9 for r in g)
    r = im.anatomy_pipeline(long_of(spark).where("target = 'p1'"), [runner.Arm("ridge", "ridge")], first_origin=70)
    assert {x["feature"] for x in im.forecast_shapley_output(r).collect()} == {"lag0", "lag1", "lag2"}
    assert im.forecast_shapley_output(r, "pbsv").count() == 3 and set(reporting.anatomy_tables(r)) == {"anatomy_contributions", "anatomy_importance", "anatomy_performance"}
    w = im.dual_from_forecast_result(long_of(spark).where("target = 'p1'"), runner.Arm("ols", "ols"), 70)
    assert all(abs(x["total"] - 1) < 1e-9 for x in w.diagnostics.collect())


# Tests.


def test_stacked_and_nested_tests(fc):
    rows = fc.select("target", "horizon", "date", "model", "prediction", "actual")
    got = joint_tests.dmp_test(rows, "naive").collect()
    assert got and all(0 <= r["p_value"] <= 1 for r in got if r["p_value"] is not None)
    t = joint_tests.equal_predictive_tests(rows, "naive").toPandas()
    assert set(t["test"]) == {"dm", "gw", "dmp"}
    n = joint_tests.nested_tests(rows, "naive").toPandas()
    assert set(n["test"]) == {"cw", "enc_new", "enc_t"} and n[n["test"] == "enc_new"]["p_value"].isna().all()
    rc = joint_tests.blocked_oob_reality_check(rows, "naive", n_boot=99).toPandas()
    assert ((rc["familywise_p_value"] >= rc["p_value"] - 1e-12) & (rc["p_value"] >= 0)).all()
    r = joint_tests.custom_test("t", lambda a: (a.mean(), 0.01), np.ones(5))
    assert r.decision and r.summary()["test"] == "t"


def test_shortfall_of_transforms(spark):
    rng = np.random.default_rng(7)
    rows = [(k, i, float(v)) for k, u in (("good", rng.random(600)), ("heavy", rng.random(600) ** 2)) for i, v in enumerate(u)]
    df = spark.createDataFrame(rows, "model string, date int, pit double")
    for boot in (False, True):
        got = {r["model"]: r for r in joint_tests.shortfall_de_test(df, 0.1, 2, by=("model",), boot=boot, n_boot=400).collect()}
        assert got["heavy"]["unconditional_p"] < 0.01 < got["good"]["unconditional_p"] and 0 <= got["good"]["conditional_p"] <= 1
    u = np.array([v for k, _, v in rows if k == "good"])
    s = np.where(u <= 0.1, (0.1 - u) / 0.1, 0)
    assert got["good"]["mean"] == pytest.approx(s.mean())
    a = s - 0.05
    want = 600 * sum(((a[k:] * a[:-k]).sum() / (600 - k) / (a**2).mean()) ** 2 for k in (1, 2))
    assert got["good"]["conditional"] == pytest.approx(want)


def test_vector_residual_tests_by_group(spark):
    rng = np.random.default_rng(8)
    rows = [(g, str(d)[:10], *map(float, rng.normal(size=2))) for g in "ab" for d in pd.date_range("2000-01-01", periods=80)]
    df = spark.createDataFrame(rows, "g string, date string, x double, y double").withColumn("date", F.col("date").cast("date"))
    got = joint_tests.var_residual_tests(df, ["x", "y"], by=("g",)).toPandas()
    assert len(got) == 6 and got["p_value"].between(0, 1).all()


# Suites, preprocessing and windows.


def test_reports_of_panels(spark, wide):
    raw = wide.withColumn("p1", F.when(F.col("date") == wide.agg(F.min("date")).first()[0], None).otherwise(F.col("p1")))
    done = clean.mean_impute_clean(raw).where("date > '1995-06-01'")
    r = suites.analyze_data(raw, done)
    e = {x["series"]: x for x in r["effects"].collect()}
    assert e["p1"]["n_changed"] == 0 and e["p2"]["n_rows_dropped"] == raw.count() - done.count()
    assert [x["stage"] for x in r["snapshots"].collect()] == ["raw", "clean"]
    assert set(suites.summarize_data(wide, correlation="pearson", outliers=True).tables) == {"snapshot", "univariate", "coverage", "missing", "correlation", "outliers"}
    made = features.marx(features.lag(wide, ["p2"], (1, 2, 4)), ["p3"], 3)
    d = suites.diagnose_features(made, "p1", {"raw": wide, "made": made}, correlation=True, max_lag=2)
    lags = d["lags"].first()
    assert (lags["source"], lags["n_lags"], lags["last"], lags["complete"]) == ("p2", 3, 4, False) and d["marx"].first()["least_weight"] == pytest.approx(1 / 3)
    assert d["stages"].count() == 2 and d["lag_autocorrelation"].count() == 6
    f = suites.factor_loadings(wide, ["p2", "p3"], ["p1"]).collect()
    assert f[0]["loading"] == pytest.approx(wide.stat.corr("p1", "p2"))
    assert suites.mackinnon_pp_pvalue(-2.86, 100_000) == pytest.approx(0.05, abs=1e-3) and suites.mackinnon_pp_pvalue(-5, 100) < suites.mackinnon_pp_pvalue(-1, 100)


def test_traces_of_forecasts(spark, fc, tmp_path):
    assert set(suites.diagnose_forecasts(fc, "naive", 2, 5, 6).tables) == {"overview", "residuals", "first_vs_last", "residual_acf", "residual_qq", "rolling_loss", "cumulative"}
    t = suites.training_loss_trace(long_of(spark).where("target = 'p1'"), [runner.Arm("ols", "ols")], (1,), 70)
    assert suites.rolling_training_loss(t, window=2).where("rolling IS NOT NULL").count() == t.count() - 1
    recs = [{"target": "p1", "arm": "a", "horizon": 1, "origin_pos": o, "kind": "parameter", "name": "alpha", "value": v} for o, v in ((1, 0.1), (2, 0.1), (3, 1.0))]
    suites.append_selection_records(spark, str(tmp_path), recs)
    suites.append_selection_records(spark, str(tmp_path), recs[2:])
    h = suites.load_selection_history_frame(spark, str(tmp_path))
    assert h.count() == 3 and [r["changed"] for r in suites.tuning_trace(h).orderBy("origin_pos").collect()] == [False, False, True]
    o = windows.origins(spark, 40, windows.spec(test=windows.test_origins(first_origin=30)))
    assert [r["age"] for r in suites.stage_update_trace(o, windows.stage_policy(update="every_k", every=3)).orderBy("origin_pos").limit(4).collect()] == [0, 1, 2, 0]
    c = suites.resolve_combinations(["mean", suites.combination_spec("median", "m", ["naive", "drift"])])
    assert [x.name for x in c] == ["comb_mean", "m"] and c[1].apply(fc.select("target", "horizon", "date", "model", "prediction", "actual")).count() > 0
    p = suites.forecast_panel_origin(order_panel(spark, SF).dropna(), P[:3], "var", 2, 60)
    assert p.where("target = 'p1'").count() == order_panel(spark, SF).dropna().count() - 62
    r = suites.ForecastResult(fc).with_sidecar("dual", 1)
    assert r.get_sidecar("dual") == 1 and r.evaluate("naive").count() > 0
    s = suites.trading_summary(suites.trading_strategy(fc.where("horizon = 1")))
    assert s.where("max_drawdown <= 0").count() == s.count()


def test_mixed_factor_diagnostics(spark):
    rng = np.random.default_rng(9)
    f = np.cumsum(rng.normal(size=72)) * 0.2
    rows = [(str(d)[:10], float(f[i] + 0.1 * rng.normal()), float(-f[i] + 0.1 * rng.normal()), float(f[i]) if i % 3 == 2 else None) for i, d in enumerate(pd.date_range("2000-01-01", periods=72, freq="MS"))]
    df = spark.createDataFrame(rows, "date string, a double, b double, q double").withColumn("date", F.col("date").cast("date"))
    assert suites.dfm_idiosyncratic_acf(df, ["a", "b", "q"], ["q"], 2, maxiter=3).count() == 4
    assert suites.dfm_factor_stability(df, ["a", "b", "q"], ["q"], maxiter=3).first()["iterations"] <= 3


def test_preprocessing_plans_and_store(spark, wide, tmp_path):
    spec = clean.PreprocessSpec({"p1": 5, "p2": 2}, outliers="winsorize")
    assert [s for s, _ in clean.plan(spec)] == ["transform", "lag rows", "outliers", "impute", "standardize", "edges"]
    store = clean.PreprocessorStore(spark, str(tmp_path / "s"))
    assert store.get(spec, "v1") is None
    fitted = spec.fit(wide)
    store.put(fitted, "v1")
    a, b = (x.transform(wide).orderBy("date").toPandas() for x in (fitted, store.get(spec, "v1")))
    assert np.allclose(a[["p1", "p2"]], b[["p1", "p2"]], equal_nan=True) and store.get(spec, "v2") is None
    with pytest.raises(clean.UndigestiblePreprocessorSpec):
        store.key(clean.PreprocessSpec({"p1": lambda: 1}), "v")
    assert clean.report(wide).where("series = 'p1'").first()["n"] == wide.count()
    y = np.exp(np.random.default_rng(10).normal(size=400))
    assert abs(clean.box_cox_lambda(y)) < 0.15 and -1 <= clean.box_cox_lambda(y + 3, "guerrero") <= 2
    assert clean.fred_sd_transform_codes(["UR_CA", "NA_TX", "X_TX"], {"UNRATE": 2, "PAYEMS": 5}, {"UR": "UNRATE", "NA": "PAYEMS"}, {"NA": 6}) == {"UR_CA": 2, "NA_TX": 6}


def test_windows_groups_and_frequencies(spark, wide):
    assert windows.normalize_window_name("Moving") == "rolling" and windows.resolve_window("recursive").estimation.mode == "expanding"
    x, y = wide.select("date", "p1").limit(5), wide.select("date", F.when(F.col("p2") > 0, F.col("p2")).alias("t"))
    assert windows.alignment_drop_incomplete().align(x, y).count() == 5
    assert windows.alignment_keep_missing("full", False).align(x, y).count() == wide.count()
    o = windows.origins(spark, 40, windows.spec(test=windows.test_origins(first_origin=38)))
    p = windows.custom_stage_policy(lambda pos, origin: pos > origin - 5)
    assert windows.stage_panel(wide, o, p).where("pos <= origin_pos").groupBy("origin_pos").count().first()["count"] == 5
    with pytest.raises(ValueError):
        windows.resolve_stage_policy("nope")
    b = panel.set_frequencies(panel.DataBundle(wide, {}), {"p1": "monthly"}, "quarterly")
    assert b.metadata["frequencies"]["p2"] == "quarterly"
    with pytest.raises(panel.PanelError):
        panel.set_frequencies(panel.DataBundle(wide, {}), {"nope": "monthly"}, "monthly")
    assert len(loaders.resolve_fred_sd_state_group("contiguous_48_plus_dc")) == 49 and loaders.resolve_fred_sd_state_group() is None
    assert set(loaders.resolve_fred_sd_state_group("census_region_northeast")) == set("CT ME MA NH RI VT NJ NY PA".split())
    assert loaders.resolve_fred_sd_variable_group(members=["UR"]) == ["UR"] and loaders.parse_version("2020-03") == (2020, 3)
    with pytest.raises(loaders.RawVersionFormatError):
        loaders.parse_version("2020-13")
    with pytest.raises(ValueError):
        loaders.resolve_fred_sd_state_group("nope")


# Reports.


def test_bundles_and_tables(spark, fc, tmp_path):
    from tidecast.operators import metrics, tests_stat

    acc, dm = study.accuracy_against(fc, "naive"), tests_stat.dm_test(fc, "naive")
    bundle = reporting.bundle_outputs(fc, {"accuracy": acc}, {"dm": dm}, more={"x": acc}, metadata={"a": {"b": 1}})
    assert set(bundle.tables) == {"forecasts", "summary", "evaluation_accuracy", "tests", "x"} and bundle.index(spark).count() == 5
    assert list(reporting.name_outputs(reporting.select_outputs(bundle, ["x"]), "numbered", "run").tables) == ["run_01_x"]
    with pytest.raises(KeyError):
        reporting.select_outputs(bundle, ["nope"])
    assert reporting.select_outputs(bundle, ["x", "tests"]).write(str(tmp_path / "o"))["artifacts"][0]["name"] == "x"
    assert reporting.metadata_table(spark, bundle.metadata).first()["field"] == "a.b"
    assert set(reporting.collect_provenance(spark, ("spark", "python"))) == {"spark", "python"}
    t = reporting.forecast_test_table(dm, caption="Tests")
    assert "Tests" in t.render() and "\\begin{table}" in t.render("latex") and "<table>" in t.render("html")
    p = reporting.paper_accuracy_frame(acc, dm)
    assert p.columns == ["target", "model", "1", "3"] and p.where("model = 'naive'").first()["1"] == "1.00"
    assert "%" in reporting.accuracy_table(acc).render() and "rank" in reporting.model_comparison_table(acc).render()
    assert set(reporting.evaluation_report_tables(metrics.evaluate_report(fc, "naive"))) == {"scores", "ranking", "benchmark", "decomposition"}
    w = reporting.pairwise_test_frame(fc.where("model IN ('naive', 'drift')"), "p1", 1)
    assert w.columns == ["model", "drift", "naive"] and w.first()["drift"] is None
    svg = reporting.forecast_path_plot(fc, "p1", 1, ["naive"])
    assert svg.count("<polyline") == 2 and reporting.fluctuation_test_plot(fc, "naive", "p1", 1, 12, 2.0).startswith("<svg")
    assert "<svg" in reporting.pit_histogram_plot(spark.range(50).select((F.col("id") / 50).alias("pit")))
    assert reporting.test_provenance_table(dm.withColumn("test", F.lit("dm"))).frame.first()["n_results"] == dm.count()
    assert reporting.report_bundle({"a": t}).render().startswith("**Tests**")


def test_command_line(spark, capsys):
    from tidecast.__main__ import main

    assert main([]) == 0 and "flagship_accuracy" in capsys.readouterr().out
    assert main(["panel_info", "--data", SF]) == 0
    with pytest.raises(SystemExit):
        main(["nope"])
