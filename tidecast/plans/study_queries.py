"""Declared studies, policies, subsamples, calibration and attribution."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import interpret_models as im
from ..operators import interpret, joint_tests, metrics, runner, searching, specs, study, suites
from ..operators.forecasters import DEFAULT, window_forecasts
from ..sources import reporting
from .bases import FORECAST_SQL, ORDER_LONG_SQL, SCALE, P, forecasts, order_long, order_panel, table
from .registry import query

X = f"WITH {FORECAST_SQL} "
L = f"WITH {ORDER_LONG_SQL} "
G = "target, horizon, model"
E = "(actual - prediction)"
WD = "PARTITION BY target, horizon, model ORDER BY date"


def _long(s, d):
    return order_long(s, d).select(F.col("series").alias("target"), "date", F.col("value").alias("y"))


# Contributions of three series to a linear forecast of the first: base 0.1, coefficients as given.
_C = {"p2": 0.5, "p3": -0.25, "p4": 0.4}


def _contributions(s, d):
    b = F.create_map(*[F.lit(v) for c, v in _C.items() for v in (c, v)])
    rows = order_panel(s, d).dropna().unpivot(["date", "p1"], list(_C), "feature", "x")
    return rows.select("date", "feature", (b[F.col("feature")] * F.col("x")).alias("contribution"), F.lit(0.1).alias("base_value"), F.col("p1").alias("actual"))


_CS = L + ", w AS (SELECT * FROM wide WHERE " + " AND ".join(f"{p} IS NOT NULL" for p in P) + "), k AS (" + " UNION ALL ".join(
    f"SELECT date, '{c}' AS feature, {v} * {c} AS c, p1 - 0.1 AS r FROM w" for c, v in _C.items()
) + "), t AS (SELECT *, sum(c) OVER (PARTITION BY date) AS total FROM k)"
query("interpret_performance_shapley", _CS + " SELECT feature, avg(c * (total - 2 * r)) AS pbsv, avg(abs(c * (total - 2 * r))) AS abs_pbsv, count(*) AS n_rows, avg(r * r) AS baseline_loss, avg((r - total) ^ 2) AS full_loss FROM t GROUP BY 1", "pbsv abs_pbsv baseline_loss full_loss")(
    lambda s, d: im.performance_shapley_value(_contributions(s, d))
)
query("interpret_performance_shapley_local", _CS + " SELECT date, feature, c AS forecast_contribution, c * (total - 2 * r) AS pbsv, r * r AS baseline_loss, (r - total) ^ 2 AS full_loss FROM t", "forecast_contribution pbsv baseline_loss full_loss")(
    lambda s, d: im.performance_shapley_value(_contributions(s, d), local=True)
)
query("interpret_oshapley_vi", _CS + ", v AS (SELECT feature, avg(abs(c)) AS importance FROM t GROUP BY 1) SELECT *, CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INT) AS rank FROM v", "importance")(
    lambda s, d: im.oshapley_vi(_contributions(s, d).withColumn("arm", F.lit("linear")), ("arm",)).drop("arm")
)
query("interpret_lineage", _CS + ", v AS (SELECT feature, avg(abs(c)) AS importance FROM t GROUP BY 1) SELECT CASE feature WHEN 'p2' THEN 'levels' WHEN 'p3' THEN 'levels' ELSE 'unknown' END AS pipeline, sum(importance) AS importance, count(*) AS n_features FROM v GROUP BY 1", "importance")(
    lambda s, d: im.lineage_attribution(
        im.oshapley_vi(_contributions(s, d).withColumn("arm", F.lit("linear")), ("arm",)), s.createDataFrame([("p2", "levels"), ("p3", "levels")], "feature string, pipeline string")
    )
)
_U = X + f", m AS (SELECT {G}, avg({E} ^ 2) AS loss FROM fc GROUP BY ALL), u AS (SELECT *, max(loss) OVER w AS baseline, max(loss) OVER w - loss AS u, count(*) OVER w AS n FROM m WINDOW w AS (PARTITION BY target, horizon)), v AS (SELECT *, sum(u) OVER (PARTITION BY target, horizon) AS total FROM u)"
for _m, _e in {
    "shapley_over_pipelines": "(u * h - (total - u) / (n - 1) * (h - 1)) / n", "marginal_addition": "u", "leave_one_out_pipeline": "total / n - (total - u) / (n - 1)",
}.items():
    query(f"interpret_transformation_{_m}", _U + f", x AS (SELECT *, list_sum(list_transform(range(1, n + 1), lambda k: 1.0::DOUBLE / k)) AS h FROM v) SELECT target, horizon, model AS pipeline, loss, u AS utility, {_e} AS contribution, baseline FROM x", "loss utility contribution baseline")(
        lambda s, d, m=_m: im.transformation_attribution(metrics.evaluate_forecasts(forecasts(s, d), ("target", "horizon", "model"), ["mse"]), method=m)
    )
_WT = L + ", w AS (SELECT date, series AS source_date, value / sum(value) OVER (PARTITION BY date) - 0.15 AS weight FROM olong)"


def _weights(s, d):
    w = F.col("value") / F.sum("value").over(Window.partitionBy("date"))
    return order_long(s, d).select("date", F.col("series").alias("source_date"), (w - 0.15).alias("weight"))


query("interpret_episode_groups", _WT + " SELECT date, CASE WHEN source_date IN ('p1', 'p2') THEN 'urgent' WHEN source_date = 'p5' THEN 'low' ELSE 'other' END AS episode_group, sum(weight) AS weight, sum(abs(weight)) AS abs_weight, count(DISTINCT source_date) AS n_episodes FROM w GROUP BY 1, 2", "weight abs_weight")(
    lambda s, d: im.episode_group_weights(_weights(s, d), {"urgent": ["p1", "p2"], "low": ["p5"]})
)
_DUAL = "WITH " + ORDER_LONG_SQL + ", n AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date) - 1 AS pos, lead(value) OVER (PARTITION BY series ORDER BY date) AS nx, lead(date) OVER (PARTITION BY series ORDER BY date) AS nd, count(*) OVER (PARTITION BY series) AS t FROM olong)"
query("interpret_dual_weights", _DUAL + """, o AS (SELECT series, pos AS o, value AS xo, nd FROM n WHERE pos >= 60 AND pos < t - 1 AND value IS NOT NULL), j AS (SELECT o.series, o.o, o.nd AS date, xo, n.value AS x, n.nd AS source_date FROM o JOIN n ON n.series = o.series AND n.pos < o.o WHERE n.value IS NOT NULL AND n.nx IS NOT NULL)
SELECT series AS target, date, source_date, 1 / count(*) OVER w + (xo - avg(x) OVER w) * (x - avg(x) OVER w) / (var_pop(x) OVER w * count(*) OVER w) AS weight FROM j WINDOW w AS (PARTITION BY series, o)""", "weight")(
    lambda s, d: im.dual_weights(_long(s, d), runner.Arm("ar1", "ols", lags=1), 60)
)


# Accuracy under policies and in subsamples.
def _policies(s, d):
    """Each model twice: as it is, and shrunk a tenth toward zero under another policy."""
    f = forecasts(s, d)
    return f.withColumn("forecast_policy", F.lit("direct")).unionByName(f.withColumns({"forecast_policy": F.lit("shrunk"), "prediction": 0.9 * F.col("prediction")}))


query("evaluate_cross_policy", X + f""", q AS (SELECT *, 'direct' AS pol FROM fc UNION ALL SELECT * REPLACE (0.9 * prediction AS prediction), 'shrunk' FROM fc), j AS (SELECT q.*, b.prediction AS bench FROM q JOIN (SELECT target, horizon, date, prediction FROM fc WHERE model = 'naive') b USING (target, horizon, date) WHERE q.actual IS NOT NULL AND q.prediction IS NOT NULL AND b.prediction IS NOT NULL),
a AS (SELECT {G}, pol, avg({E} ^ 2) AS m, avg((actual - bench) ^ 2) AS b, count(*) AS n FROM j GROUP BY ALL)
SELECT target, horizon, model || '::' || pol AS contender, model AS arm, pol AS forecast_policy, sqrt(m) AS rmse, CASE WHEN b > 0 THEN m / b END AS relative_mse, 1 - CASE WHEN b > 0 THEN m / b END AS r2_oos, n AS n_common, model = 'naive' AND pol = 'direct' AS is_benchmark FROM a""", "rmse relative_mse r2_oos")(
    lambda s, d: study.evaluate_cross_policy(_policies(s, d), "naive", "direct")
)
_SUB = study.SubsampleWindow("1998-01-01", "2000-12-01", (("1999-03-01", "1999-06-01"),))
query("evaluate_subsample", X + f""", j AS (SELECT f.*, b.prediction AS bench FROM fc f JOIN (SELECT target, horizon, date, prediction FROM fc WHERE model = 'naive') b USING (target, horizon, date) WHERE f.actual IS NOT NULL AND f.prediction IS NOT NULL AND b.prediction IS NOT NULL AND f.date BETWEEN DATE '1998-01-01' AND DATE '2000-12-01' AND NOT f.date BETWEEN DATE '1999-03-01' AND DATE '1999-06-01'),
a AS (SELECT {G}, avg({E} ^ 2) AS m, avg((actual - bench) ^ 2) AS b, count(*) AS n FROM j GROUP BY ALL) SELECT {G}, sqrt(m) AS rmse, CASE WHEN b > 0 THEN m / b END AS relative_mse, 1 - CASE WHEN b > 0 THEN m / b END AS r2_oos, n AS n_common, model = 'naive' AS is_benchmark FROM a""", "rmse relative_mse r2_oos")(
    lambda s, d: study.accuracy_against(forecasts(s, d).where(_SUB.condition()), "naive")
)


def _density(s, d):
    w = Window.partitionBy("target", "horizon", "model").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    f = forecasts(s, d)
    v = f.withColumn("variance_prediction", F.avg(F.pow(F.col("actual") - F.col("prediction"), 2)).over(w)).where("variance_prediction > 0")
    half = 1.645 * F.sqrt("variance_prediction")
    return v.withColumns({"lower": F.col("prediction") - half, "upper": F.col("prediction") + half})


V = X + f", v0 AS (SELECT *, avg({E} ^ 2) OVER ({WD} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS v FROM fc), v AS (SELECT *, {E} / sqrt(v) AS z, prediction - 1.645 * sqrt(v) AS lo, prediction + 1.645 * sqrt(v) AS hi FROM v0 WHERE v > 0)"
query("pipeline_density", V + f" SELECT {G}, avg((actual BETWEEN lo AND hi)::INT) AS coverage_rate, avg(hi - lo) AS interval_width, avg(CASE WHEN actual IS NOT NULL THEN hi - lo + 20 * (CASE WHEN actual < lo THEN lo - actual ELSE 0 END + CASE WHEN actual > hi THEN actual - hi ELSE 0 END) END) AS interval_score, count({E}) AS n FROM v GROUP BY ALL", "coverage_rate interval_width interval_score")(
    lambda s, d: study.density_table(_density(s, d), study.Evaluation("naive", metrics=("coverage_rate",), calibration_alpha=0.1))
)
query("pipeline_berkowitz", V + f""", b AS (SELECT *, lag(z) OVER ({WD}) AS l FROM v WHERE z IS NOT NULL), g AS (SELECT {G}, count(*) AS n_obs, sum(z ^ 2) AS s0, regr_syy(z, l) AS syy, regr_sxy(z, l) AS sxy, regr_sxx(z, l) AS sxx FROM b WHERE l IS NOT NULL GROUP BY ALL)
SELECT {G}, n_obs, s0 - n_obs * (ln((syy - CASE WHEN sxx > 0 THEN sxy ^ 2 / sxx ELSE 0 END) / n_obs) + 1) AS statistic FROM g WHERE n_obs >= 4""", "statistic")(
    lambda s, d: study.berkowitz_statistics(_density(s, d).withColumn("z", (F.col("actual") - F.col("prediction")) / F.sqrt("variance_prediction")).where("z IS NOT NULL"))
)
query("pipeline_calibration")(lambda s, d: study.calibration_table(_density(s, d), study.Evaluation("naive", tests=study.CALIBRATION_TESTS, calibration_alpha=0.1)))

# A whole declared study whose arms have closed forms.


def _study(s, d):
    arms = [runner.Arm("rw", "naive"), runner.Arm("mean", "hist_mean")]
    spec = study.pipeline_spec(
        data=_long(s, d), targets=[study.TargetSpec(p, "change", "direct") for p in P], horizons=(1,), arms=arms, evaluation=study.Evaluation("rw", tests=("dm",)),
        combinations=[study.CombinationContender("both", "mean", ("rw", "mean"))], first_origin=36,
    )
    return study.run_study(spec)


_ST = "WITH " + ORDER_LONG_SQL + """, c AS (SELECT series AS target, date, value - lag(value) OVER (PARTITION BY series ORDER BY date) AS y, row_number() OVER (PARTITION BY series ORDER BY date) - 1 AS pos FROM olong),
f AS (SELECT target, date, pos, y AS actual, last_value(y IGNORE NULLS) OVER w AS rw, avg(y) OVER w AS mean FROM c WINDOW w AS (PARTITION BY target ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
u AS (SELECT target, date, actual, rw, m, p FROM (SELECT target, date, actual, rw, rw AS a, mean AS b, (rw + mean) / 2 AS d FROM f WHERE pos >= 37) CROSS JOIN LATERAL (VALUES ('rw', a), ('mean', b), ('both', d)) x(m, p) WHERE actual IS NOT NULL)"""
query("study_accuracy", _ST + " SELECT target, 1 AS horizon, m AS model, sqrt(avg((actual - p) ^ 2)) AS rmse, avg((actual - p) ^ 2) / avg((actual - rw) ^ 2) AS relative_mse, 1 - avg((actual - p) ^ 2) / avg((actual - rw) ^ 2) AS r2_oos, count(*) AS n_common, m = 'rw' AS is_benchmark FROM u GROUP BY target, m", "rmse relative_mse r2_oos")(
    lambda s, d: _study(s, d).accuracy
)
query("study_significance")(lambda s, d: _study(s, d).significance)
query("study_anatomy")(lambda s, d: im.precompute_anatomy(_long(s, d), [runner.Arm("ridge", "ridge")], (1,), 60))
query("study_anatomy_linear", _DUAL.replace("WITH ", "WITH ", 1) + """, o AS (SELECT series, pos AS o, value AS xo, nx AS actual, nd FROM n WHERE pos >= 60 AND pos < t - 1 AND value IS NOT NULL), j AS (SELECT o.*, n.value AS x, n.nx AS y FROM o JOIN n ON n.series = o.series AND n.pos < o.o WHERE n.value IS NOT NULL AND n.nx IS NOT NULL),
g AS (SELECT series, o, nd, xo, actual, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(x) AS m FROM j GROUP BY ALL) SELECT series AS target, 'ar1' AS arm, 1 AS horizon, CAST(o AS INT) AS origin_pos, nd AS date, 'lag0' AS feature, b * (xo - m) AS contribution, a + b * m AS base_value, a + b * xo AS prediction, actual FROM g""", "contribution base_value prediction actual")(
    lambda s, d: im.precompute_anatomy(_long(s, d), [runner.Arm("ar1", "ols", lags=1)], (1,), 60, background=10_000)
)


# Arms with closed forms: whole runs against window aggregates.
W = "PARTITION BY series ORDER BY date"


def _run_sql(h: int, first: int, arm: str, prediction: str, more: str = "", policy: str = "direct", actual: str = "value", model_col: bool = False) -> str:
    """The master table of one arm; ``prediction`` may use ``past`` (rows up to the origin) and the columns of ``more``."""
    past = f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND {h} PRECEDING)"
    base = f"n AS (SELECT *, row_number() OVER ({W}) - 1 AS pos, lag(date, {h}) OVER ({W}) AS origin, lag(value, {h}) OVER ({W}) AS x{more} FROM olong)"
    return (
        f"{L}, {base}, r AS (SELECT *, {prediction.format(past=past)} AS p, {actual} AS a FROM n) SELECT series AS target, {h} AS horizon, origin, CAST(pos - {h} AS INT) AS origin_pos, date, "
        f"'{arm}' AS arm, p AS prediction, a AS actual, '{policy}' AS forecast_policy, CAST(NULL AS VARCHAR) AS error FROM r WHERE pos - {h} >= {first}"
    )


for _m, _e in {
    "naive": "last_value(value IGNORE NULLS) OVER {past}", "hist_mean": "avg(value) OVER {past}", "seasonal_naive": f"lag(value, 12) OVER ({W})",
    "random_walk_drift": "last_value(value IGNORE NULLS) OVER {past} + 3 * (last_value(value IGNORE NULLS) OVER {past} - first_value(value IGNORE NULLS) OVER {past}) / (count(value) OVER {past} - 1)",
}.items():
    query(f"model_{_m}_path", _run_sql(3, 60, _m, _e), "prediction actual")(lambda s, d, m=_m: runner.run_arms(_long(s, d), [runner.Arm(m, m)], (3,), 60).drop("model"))

_ONE = ", lag(value) OVER (PARTITION BY series ORDER BY date) AS b1, lag(value, 2) OVER (PARTITION BY series ORDER BY date) AS b2, lag(value, 3) OVER (PARTITION BY series ORDER BY date) AS b3"
_REG = lambda f, k: f"regr_{f}(value, b{k}) OVER {{past}}"
_A1, _B1 = _REG("intercept", 1), _REG("slope", 1)
query("run_recursive_ar1", _run_sql(3, 48, "rec", f"{_A1} + {_B1} * ({_A1} + {_B1} * ({_A1} + {_B1} * x))", _ONE, "recursive"), "prediction actual")(
    lambda s, d: runner.run_arms(_long(s, d), [runner.Arm("rec", "ols", {}, "recursive", 1)], (3,), 48).drop("model")
)
_MEAN3 = f"CASE WHEN count(value) OVER ({W} ROWS 2 PRECEDING) = 3 THEN avg(value) OVER ({W} ROWS 2 PRECEDING) END"
_PATH = "(" + " + ".join(f"{_REG('intercept', k)} + {_REG('slope', k)} * x" for k in (1, 2, 3)) + ") / 3"
query("run_path_average_ar1", _run_sql(3, 48, "path", _PATH, _ONE, "path_average", _MEAN3), "prediction actual")(
    lambda s, d: runner.run_arms(_long(s, d), [runner.Arm("path", "ols", {}, "path_average", 1)], (3,), 48).drop("model")
)
query("run_direct_average_ar1", _run_sql(3, 48, "avg", "regr_intercept(m, b3) OVER {past} + regr_slope(m, b3) OVER {past} * x", f"{_ONE}, {_MEAN3} AS m", "direct_average", "m"), "prediction actual")(
    lambda s, d: runner.run_arms(_long(s, d), [runner.Arm("avg", "ols", {}, "direct_average", 1)], (3,), 48).drop("model")
)
query("run_rolling_window_ar1", _run_sql(1, 40, "roll", f"regr_intercept(value, b1) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN 23 PRECEDING AND 1 PRECEDING) + regr_slope(value, b1) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN 23 PRECEDING AND 1 PRECEDING) * x", _ONE), "prediction actual")(
    lambda s, d: runner.run_arms(_long(s, d), [runner.Arm("roll", "ols", lags=1)], (1,), 40, window=24).drop("model")
)

# Joint and tail tests.
_D = X + f", j AS (SELECT f.*, b.prediction AS bench FROM fc f JOIN (SELECT target, horizon, date, prediction FROM fc WHERE model = 'naive') b USING (target, horizon, date) WHERE f.actual IS NOT NULL AND f.prediction IS NOT NULL AND b.prediction IS NOT NULL), d AS (SELECT *, (actual - prediction) ^ 2 - (actual - bench) ^ 2 AS d FROM j WHERE model <> 'naive' QUALIFY count(*) OVER (PARTITION BY target, horizon, model) >= 8)"
_TM, _TO = "PARTITION BY target, model", "PARTITION BY target, model ORDER BY horizon, date"
query("test_dmp", _D + f""", c AS (SELECT *, d - avg(d) OVER ({_TM}) AS cd, avg(d) OVER ({_TM}) AS cm, least(floor(count(*) OVER ({_TM}) ^ (1.0 / 3)), count(*) OVER ({_TM}) - 1) AS lags FROM d),
k AS (SELECT *, {", ".join(f"cd * lag(cd, {i}) OVER ({_TO}) AS p{i}" for i in range(1, 9))} FROM c),
s AS (SELECT target, model, count(*) AS n, max(cm) AS mean, sum(cd * cd) / count(*) AS g0, {" + ".join(f"CASE WHEN max(lags) >= {i} THEN 2 * (1 - {i} / (max(lags) + 1)) * coalesce(sum(p{i}), 0) / count(*) ELSE 0 END" for i in range(1, 9))} AS g FROM k GROUP BY 1, 2)
SELECT target, model, n, mean / sqrt(CASE WHEN g0 + g > 0 THEN g0 + g ELSE g0 END / n) AS statistic FROM s""", "statistic")(
    lambda s, d: joint_tests.dmp_statistics(forecasts(s, d), "naive")
)


def _pit(s, d):
    w = Window.partitionBy("target", "horizon", "model").orderBy("actual")
    return forecasts(s, d).where("actual IS NOT NULL").withColumn("pit", F.percent_rank().over(w))


query("test_shortfall", X + f""", p AS (SELECT *, percent_rank() OVER (PARTITION BY {G} ORDER BY actual) AS u FROM fc WHERE actual IS NOT NULL), a AS (SELECT *, CASE WHEN u <= 0.2 THEN (0.2 - u) / 0.2 ELSE 0 END AS s FROM p), b AS (SELECT *, s - 0.1 AS a, (s - 0.1) * lag(s - 0.1) OVER ({WD}) AS p1, (s - 0.1) * lag(s - 0.1, 2) OVER ({WD}) AS p2 FROM a)
SELECT {G}, count(*) AS n, avg(s) AS mean, sqrt(count(*)) * (avg(s) - 0.1) / sqrt(0.2 * (1.0 / 3 - 0.2 / 4)) AS unconditional, count(*) * ((sum(p1) / (count(*) - 1) / avg(a * a)) ^ 2 + (sum(p2) / (count(*) - 2) / avg(a * a)) ^ 2) AS conditional FROM b GROUP BY ALL""", "mean unconditional conditional")(
    lambda s, d: joint_tests.shortfall_de_statistics(_pit(s, d), 0.2, 2)
)
query("test_blocked_reality_check")(lambda s, d: joint_tests.blocked_oob_reality_check(forecasts(s, d), "naive", n_boot=199))
query("test_var_residuals")(lambda s, d: joint_tests.var_residual_tests(order_panel(s, d).dropna(), P[:3]))

# Suites.
_RAW = L + ", cl AS (SELECT date, series, CASE WHEN value IS NULL THEN avg(value) OVER (PARTITION BY series) WHEN value > 2 * avg(value) OVER (PARTITION BY series) THEN NULL ELSE value END AS value FROM olong)"


def _clean_column(p):
    w = Window.partitionBy()
    return F.when(F.col(p).isNull(), F.avg(p).over(w)).when(F.col(p) > 2 * F.avg(p).over(w), None).otherwise(F.col(p))


def _cleaned(s, d):
    return order_panel(s, d).select("date", *[_clean_column(p).alias(p) for p in P])


def _cleaned_cells(s, d):
    """series, date, raw, clean, there of one computation of the panel."""
    pairs = order_panel(s, d).select("date", *[F.struct(F.col(p).alias("raw"), _clean_column(p).alias("clean")).alias(p) for p in P])
    return pairs.where("date IS NOT NULL").unpivot(["date"], P, "series", "cell").select("series", "date", "cell.raw", "cell.clean", F.lit(1).alias("there"))


query("analysis_panel_snapshots", _RAW + " SELECT 'raw' AS stage, count(DISTINCT date) AS n_rows, count(DISTINCT series) AS n_series, count(*) AS n_cells, count(*) - count(value) AS n_missing, min(date) AS first, max(date) AS last FROM olong UNION ALL SELECT 'clean', count(DISTINCT date), count(DISTINCT series), count(*), count(*) - count(value), min(date), max(date) FROM cl")(
    lambda s, d: suites.panel_snapshots(order_panel(s, d), _cleaned(s, d))
)
query("analysis_cleaning_effects", _RAW + " SELECT series, count(*) FILTER (o.value IS NULL AND c.value IS NOT NULL) AS n_imputed, count(*) FILTER (o.value IS NOT NULL AND c.value IS NULL) AS n_removed, count(*) FILTER (o.value <> c.value) AS n_changed, 0::BIGINT AS n_rows_dropped FROM olong o JOIN cl c USING (series, date) GROUP BY 1")(
    lambda s, d: suites.cell_effects(_cleaned_cells(s, d))
)
query("diagnostic_factor_loadings", L + " " + " UNION ALL ".join(f"SELECT '{f}' AS factor, '{x}' AS source, corr({f}, {x}) AS loading, count(*) FILTER ({f} IS NOT NULL AND {x} IS NOT NULL) AS n FROM wide" for f in ("p1", "p2") for x in ("p3", "p4", "p5")), "loading")(
    lambda s, d: suites.factor_loadings(order_panel(s, d), ["p3", "p4", "p5"], ["p1", "p2"])
)
query("diagnostic_feature_stages", _RAW + " SELECT 'raw' AS stage, count(DISTINCT date) AS n_rows, count(DISTINCT series) AS n_series, (count(*) - count(value)) / count(*) AS missing_rate, min(date) AS first, max(date) AS last FROM olong UNION ALL SELECT 'clean', count(DISTINCT date), count(DISTINCT series), (count(*) - count(value)) / count(*), min(date), max(date) FROM cl", "missing_rate")(
    lambda s, d: suites.compare_feature_stages({"raw": order_panel(s, d), "clean": _cleaned(s, d)})
)
query("diagnostic_trading", X + f""", t AS (SELECT target, horizon, model, date, sign(prediction - lag(actual) OVER ({WD})) * (actual - lag(actual) OVER ({WD})) AS profit FROM fc WHERE actual IS NOT NULL), u AS (SELECT *, sum(profit) OVER ({WD}) AS c FROM t WHERE profit IS NOT NULL), v AS (SELECT *, c - max(c) OVER ({WD}) AS dd FROM u)
SELECT {G}, avg(profit) / nullif(stddev_samp(profit), 0) * sqrt(252) AS sharpe_ratio, min(dd) AS max_drawdown, sum(profit) * 252 / count(*) AS annual_profit FROM v GROUP BY ALL""", "sharpe_ratio max_drawdown annual_profit")(
    lambda s, d: suites.trading_summary(suites.trading_strategy(forecasts(s, d).where("actual IS NOT NULL"), ("target", "horizon", "model")), ("target", "horizon", "model")).drop("max_drawdown_date")
)
query("diagnostic_training_loss", _DUAL + """, o AS (SELECT series, pos AS o, date AS od FROM n WHERE pos >= 60 AND pos < t - 1), j AS (SELECT o.series, o.o, od, n.value AS x, n.nx AS y FROM o JOIN n ON n.series = o.series AND n.pos < o.o WHERE n.value IS NOT NULL AND n.nx IS NOT NULL),
g AS (SELECT *, regr_slope(y, x) OVER w AS b, regr_intercept(y, x) OVER w AS a FROM j WINDOW w AS (PARTITION BY series, o)) SELECT series AS target, 'ar1' AS arm, 1 AS horizon, CAST(o AS INT) AS origin_pos, od AS date, CAST(count(*) AS INT) AS n_train, avg((y - a - b * x) ^ 2) AS mse, avg(abs(y - a - b * x)) AS mae FROM g GROUP BY series, o, od""", "mse mae")(
    lambda s, d: suites.training_loss_trace(_long(s, d), [runner.Arm("ar1", "ols", lags=1)], (1,), 60)
)

# Recipes.
_WIDE = "WINDOW w AS (ORDER BY date)"
_LAGS = ", ".join(f"{c} AS {c}_lag0, lag({c}) OVER w AS {c}_lag1" for c in ("p2", "p3"))
_MEANS = ", ".join(f"CASE WHEN count({c}) OVER (ORDER BY date ROWS 2 PRECEDING) = 3 THEN avg({c}) OVER (ORDER BY date ROWS 2 PRECEDING) END AS {c}_mean3" for c in ("p2", "p3"))
query("features_recipe", f"WITH {ORDER_LONG_SQL}, f AS (SELECT date, {_LAGS}, {_MEANS}, lead(p1) OVER w AS p1_level_h1 FROM wide {_WIDE}) SELECT date, p2_lag0, p2_lag1, p3_lag0, p3_lag1, p2_mean3, p3_mean3, p1_level_h1 FROM f WHERE p2_lag0 + p2_lag1 + p3_lag0 + p3_lag1 + p2_mean3 + p3_mean3 + p1_level_h1 IS NOT NULL", "p2_lag0 p2_lag1 p3_lag0 p3_lag1 p2_mean3 p3_mean3 p1_level_h1")(
    lambda s, d: specs.feature_spec(target="p1", predictors=["p2", "p3"], lags=(0, 1), rolling_windows=3).fit_transform(order_panel(s, d)).frame
)
_MARX = ", ".join(f"CASE WHEN count(p2) OVER (ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) = {n} THEN avg(p2) OVER (ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END AS MARX_p2_marx{n}" for n in (1, 2, 3))
query("features_matrix", f"WITH {ORDER_LONG_SQL} SELECT date, p2 AS X_p2, lag(p2) OVER (ORDER BY date) AS X_p2_lag1, {_MARX} FROM wide", "X_p2 X_p2_lag1 MARX_p2_marx1 MARX_p2_marx2 MARX_p2_marx3")(
    lambda s, d: specs.feature_matrix(order_panel(s, d), "X-MARX", ["p2"], lags=(0, 1), max_lag=3)
)
query("features_group_pca")(lambda s, d: specs.group_pca(order_panel(s, d), {"high": ["p1", "p2"], "low": ["p3", "p4", "p5"]}))
query("features_pca_recipe")(lambda s, d: specs.feature_spec(target="p1", predictors=["p2", "p3", "p4"], pca_components=2).fit_transform(order_panel(s, d)).frame)
query("features_pls")(lambda s, d: specs.partial_least_squares_features(order_panel(s, d), "p1", P[1:], 2))

# Searches and vector models.


def _search(s, d, method, **o):
    f = specs.feature_spec(target="p1", predictors=["p2", "p3"], lags=(0, 1)).fit_transform(order_panel(s, d))
    spec = searching.search_spec("ridge", method=method, validation_splitter=searching.recursive_threefold(), **o)
    return searching.run_search(f.frame, "ridge", list(f.features), f.targets[0], spec).to_frame(s).select("trial", "score")


query("search_threefold")(lambda s, d: _search(s, d, "grid"))
query("search_random")(lambda s, d: _search(s, d, "random", n_iter=2))
query("run_vector_model")(lambda s, d: suites.forecast_panel_origin(order_panel(s, d).dropna(), P, "var", 1, 60))
query("run_restricted_vector_model")(lambda s, d: suites.forecast_panel_origin(order_panel(s, d).dropna(), P, "var_restricted", 1, 60))
query("report_run_summary", X + " SELECT count(*) AS n_forecasts, count(DISTINCT target) AS n_targets, count(DISTINCT horizon) AS n_horizons, count(DISTINCT model) AS n_models, count(DISTINCT date) AS n_dates, min(date) AS first, max(date) AS last, sum((prediction IS NULL)::INT)::BIGINT AS n_missing FROM fc")(
    lambda s, d: reporting.run_summary(forecasts(s, d))
)
query("report_forecast_path", X + " SELECT date, model AS line, prediction AS value FROM fc WHERE target = 'p1' AND horizon = 1 UNION ALL SELECT DISTINCT date, 'actual', actual FROM fc WHERE target = 'p1' AND horizon = 1", "value")(
    lambda s, d: reporting.forecast_path_data(forecasts(s, d), "p1", 1)
)
query("report_fluctuation_path", _D + ", m AS (SELECT *, CASE WHEN count(d) OVER w = 12 THEN avg(d) OVER w END AS m, sum(d * d) OVER (PARTITION BY model) / (count(d) OVER (PARTITION BY model) - 1) AS v FROM d WHERE target = 'p1' AND horizon = 1 WINDOW w AS (PARTITION BY model ORDER BY date ROWS 11 PRECEDING)) SELECT date, model, sqrt(12) * m / sqrt(v) AS value FROM m WHERE m IS NOT NULL AND v > 0", "value")(
    lambda s, d: reporting.fluctuation_test_data(forecasts(s, d), "naive", "p1", 1, 12)
)


# A panel of many series: supplier x size of part, by month.


def _many(s, d):
    rows = table(s, d, "lineitem").join(table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey")
    g = rows.groupBy("l_suppkey", "p_size", F.trunc("l_shipdate", "month").alias("date")).agg((F.sum("l_extendedprice") / SCALE).alias("y"))
    return g.select(F.concat_ws("-", "l_suppkey", "p_size").alias("target"), "date", "y")


_MANY = "WITH g AS (SELECT l_suppkey || '-' || p_size AS target, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, sum(l_extendedprice) / 999983.0 AS y FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)"
query("forecast_many_series", _MANY + """, f AS (SELECT target, date, y AS actual, last_value(y) OVER w AS naive, avg(y) OVER w AS hist_mean, row_number() OVER (PARTITION BY target ORDER BY date) - 2 AS pos, lag(date) OVER (PARTITION BY target ORDER BY date) AS origin FROM g WINDOW w AS (PARTITION BY target ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT target, 1 AS horizon, origin, CAST(pos AS INT) AS origin_pos, date, m AS model, p AS prediction, actual FROM (SELECT *, naive AS a, hist_mean AS b FROM f WHERE pos >= 2) CROSS JOIN LATERAL (VALUES ('naive', a), ('hist_mean', b)) x(m, p)""", "prediction actual")(
    lambda s, d: window_forecasts(_many(s, d), (1,), {"naive": DEFAULT["naive"], "hist_mean": DEFAULT["hist_mean"]}, ar1=False, min_train=2)
)
query("accuracy_many_series", _MANY + """, f AS (SELECT target, date, y, last_value(y) OVER w AS naive, avg(y) OVER w AS hist_mean, row_number() OVER (PARTITION BY target ORDER BY date) - 2 AS pos FROM g WINDOW w AS (PARTITION BY target ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT 1 AS horizon, m AS model, avg((y - p) ^ 2) AS mse, sqrt(avg((y - p) ^ 2)) AS rmse, avg(abs(y - p)) AS mae, count(*) AS n FROM (SELECT *, naive AS a, hist_mean AS b FROM f WHERE pos >= 2) CROSS JOIN LATERAL (VALUES ('naive', a), ('hist_mean', b)) x(m, p) GROUP BY 2""", "mse rmse mae")(
    lambda s, d: metrics.evaluate_forecasts(window_forecasts(_many(s, d), (1,), {"naive": DEFAULT["naive"], "hist_mean": DEFAULT["hist_mean"]}, ar1=False, min_train=2), ("horizon", "model"), ("mse", "rmse", "mae"))
)


def _study_of_many(s, d):
    """Two arms on every series of 24 months or more: one grouped job over thousands of series."""
    rows = _many(s, d).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("target"))).where("n >= 24").drop("n")
    return runner.run_arms(rows, [runner.Arm("ar1", "ols", lags=1), runner.Arm("ridge", "ridge")], (1, 3), 18, step=3).groupBy("arm", "horizon").agg(F.count("prediction").alias("n"), F.avg(F.abs(F.col("actual") - F.col("prediction"))).alias("mae"))


query("run_many_series")(_study_of_many)
_CUTS = ", ".join(str(i / 10) for i in range(1, 10))
query("interpret_ale", L + f""", q AS (SELECT quantile_cont(p2, [{_CUTS}]) AS e FROM wide WHERE p2 IS NOT NULL), b AS (SELECT CAST(1 + len(list_filter(e, lambda v: p2 > v)) AS INT) AS bin, p3 FROM wide, q WHERE p2 IS NOT NULL AND p3 IS NOT NULL),
g AS (SELECT bin, avg(p3) AS local, count(*) AS n FROM b GROUP BY 1), a AS (SELECT *, sum(local) OVER (ORDER BY bin) AS s FROM g) SELECT bin, local, n, s - sum(s * n) OVER () / sum(n) OVER () AS ale FROM a""", "local ale")(
    lambda s, d: interpret.accumulated_local_effect(order_panel(s, d).dropna(subset=["p2", "p3"]), "p2", "p3")
)
