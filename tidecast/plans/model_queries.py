"""Models, studies, factors, searches, interpretation and event panels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import econometrics, factors, interpret, runner
from ..operators.features import lag
from ..operators.kernels import MODELS
from .bases import ORDER_LONG_SQL, P, order_long, order_panel, ship_panel, table
from .registry import query

L = f"WITH {ORDER_LONG_SQL} "
W = "PARTITION BY series ORDER BY date"


def _long(spark, sf_dir):
    return order_long(spark, sf_dir).select(F.col("series").alias("target"), "date", F.col("value").alias("y"))


#: Parameters of models whose defaults take long on every origin of every series.
_LIGHT = {
    "lstm": {"max_epochs": 20, "learning_rate": 0.01, "hidden_size": 8}, "gru": {"max_epochs": 20, "learning_rate": 0.01, "hidden_size": 8},
    "transformer": {"max_epochs": 20, "learning_rate": 0.01, "hidden_size": 8}, "hemisphere_nn": {"n_estimators": 3, "neurons": 16, "learning_rate": 0.01},
    "density_hnn": {"n_estimators": 3, "prior_estimators": 2, "neurons": 16, "learning_rate": 0.01}, "booging": {"B": 4, "inner_n_estimators": 50},
    "xgboost": {"n_estimators": 50}, "lightgbm": {"n_estimators": 50, "min_child_samples": 5}, "catboost": {"n_estimators": 50}, "lgba_plus": {"n_cycles": 5},
    "stacking": {"models": ("ridge", "pcr", "knn")},
}
for _n in [n for n, m in MODELS.items() if m.kind == "supervised"]:
    query(f"model_{_n}")(lambda s, d, n=_n: runner.run_arms(_long(s, d), [runner.Arm(n, n, _LIGHT.get(n, {}))], (1,), 60).drop("model"))
for _n in [n for n, m in MODELS.items() if m.kind == "target" and n != "ucsv"]:
    query(f"model_{_n}_path")(lambda s, d, n=_n: runner.run_arms(_long(s, d), [runner.Arm(n, n)], (3,), 60).drop("model"))

query("model_ucsv_path")(lambda s, d: runner.run_arms(_long(s, d), [runner.Arm("ucsv", "ucsv", {"n_draws": 200, "burn": 80})], (3,), 60).drop("model"))

# Closed forms that SQL can check: the runner against window aggregates.
_PAST = f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_RUN = L + f", n AS (SELECT *, row_number() OVER ({W}) - 1 AS pos, lag(value) OVER ({W}) AS x, lag(date) OVER ({W}) AS origin FROM olong), "
_COLS = "series AS target, 1 AS horizon, origin, CAST(pos - 1 AS INT) AS origin_pos, date, '{0}' AS arm, {1} AS prediction, value AS actual, 'direct' AS forecast_policy, CAST(NULL AS VARCHAR) AS error"
query("run_ols_ar1", _RUN + f"r AS (SELECT *, regr_intercept(value, x) OVER {_PAST} + regr_slope(value, x) OVER {_PAST} * x AS p FROM n) SELECT {_COLS.format('ar1', 'p')} FROM r WHERE pos - 1 >= 36", "prediction actual")(
    lambda s, d: runner.run_arms(_long(s, d), [runner.Arm("ar1", "ols", lags=1)], (1,), 36).drop("model")
)
query("run_ridge_ar1", _RUN + f"r AS (SELECT *, regr_avgy(value, x) OVER w + regr_sxy(value, x) OVER w / (regr_sxx(value, x) OVER w + 1) * (x - regr_avgx(value, x) OVER w) AS p FROM n WINDOW w AS {_PAST}) SELECT {_COLS.format('ridge1', 'p')} FROM r WHERE pos - 1 >= 36", "prediction actual")(
    lambda s, d: runner.run_arms(_long(s, d), [runner.Arm("ridge1", "ridge", {"alpha": 1.0}, lags=1)], (1,), 36).drop("model")
)
query("run_hist_mean", _RUN + f"r AS (SELECT *, avg(value) OVER {_PAST} AS p FROM n) SELECT {_COLS.format('mean', 'p')} FROM r WHERE pos - 1 >= 36", "prediction actual")(
    lambda s, d: runner.run_arms(_long(s, d), [runner.Arm("mean", "hist_mean")], (1,), 36).drop("model")
)
query("run_recursive")(lambda s, d: runner.run_arms(_long(s, d), [runner.Arm("rec", "ols", {}, "recursive")], (3,), 48).drop("model"))
query("run_path_average")(lambda s, d: runner.run_arms(_long(s, d), [runner.Arm("path", "ridge", {}, "path_average")], (3,), 48).drop("model"))
_ARMS = [runner.Arm("naive", "naive"), runner.Arm("ols", "ols"), runner.Arm("ridge", "ridge"), runner.Arm("pcr", "pcr"), runner.Arm("ar_bic", "ar_bic")]
query("pipeline_master")(lambda s, d: runner.run_arms(_long(s, d), _ARMS, (1, 3), 48))
query("pipeline_accuracy")(lambda s, d: runner.evaluate(runner.run_arms(_long(s, d), _ARMS, (1,), 48), runner.EvalSpec("naive", combinations=("mean",)))["ranking"])
query("pipeline_significance")(lambda s, d: runner.evaluate(runner.run_arms(_long(s, d), _ARMS, (1,), 48), runner.EvalSpec("naive"))["significance"])


def _features(s, d):
    return lag(order_panel(s, d), P, (1, 2)).dropna("any")


_X = [f"{p}_lag{k}" for p in P for k in (1, 2)]
query("search_grid")(
    lambda s, d: runner.select_params(_features(s, d), "ridge", _X, "p1", runner.candidates({"alpha": [0.1, 1.0, 10.0, 100.0]}), [(0, 40, 40, 50), (0, 50, 50, 60), (0, 60, 60, 70)]).select("trial", "score", "best")
)
for _k in ("bagging", "subagging", "random_subspace"):
    query(f"ensemble_{_k}")(lambda s, d, k=_k: runner.ensemble(_features(s, d), "ridge", _X, "p1", 60, k))

# Factors and filters.
def _imputed_shipments(s, d, size=6):
    """series, date, value of every supplier: a factor model for each group of ``size`` consecutive suppliers."""
    panel = ship_panel(s, d)
    slots = [f"m{i}" for i in range(1, size + 1)]
    number = F.expr("CAST(substring(series, 2) AS BIGINT) - 1")
    rows = panel.withColumn("n", number).select(F.floor(F.col("n") / size).alias("block"), F.concat(F.lit("m"), F.col("n") % size + 1).alias("slot"), "date", "value")
    wide = rows.groupBy("block", "date").pivot("slot", slots).agg(F.first("value"))
    filled = factors.em_factor_impute(wide, slots, n_factors=2, by=("block",)).unpivot(["block", "date"], slots, "slot", "value")
    filled = filled.select(F.concat(F.lit("s"), F.col("block") * size + F.substring("slot", 2, 20).cast("bigint")).alias("series"), "date", "value")
    return filled.join(panel.select("series").distinct(), "series", "left_semi")  # a last group may have fewer


query("impute_em_factor")(_imputed_shipments)
query("features_pca_expanding")(lambda s, d: factors.pca_features(order_panel(s, d), P, 2))
query("features_dfm")(lambda s, d: factors.dfm_features(order_panel(s, d), 2, columns=P))
query("features_maf")(lambda s, d: factors.maf_features(order_panel(s, d), "p1", 6, 2))
query("filter_hp")(lambda s, d: factors.hp_filter(order_long(s, d), "value", by=("series",)))
query("filter_hamilton")(lambda s, d: factors.hamilton_filter(order_long(s, d), "value", by=("series",)))
query("filter_stl")(lambda s, d: factors.stl_decompose(order_long(s, d), "value", by=("series",)))
query("filter_albama")(lambda s, d: factors.albama(order_long(s, d), "value", 30, by=("series",)))
query("filter_hamilton_one_lag", L + f""", x AS (SELECT series, date, value, lag(value, 8) OVER ({W}) AS b FROM olong)
SELECT series, date, CASE WHEN b + value IS NOT NULL THEN i + k * b END AS trend, CASE WHEN b IS NOT NULL THEN value - i - k * b END AS cycle FROM x JOIN (SELECT series, regr_intercept(value, b) AS i, regr_slope(value, b) AS k FROM x GROUP BY 1) USING (series)""", "trend cycle")(
    lambda s, d: factors.hamilton_filter(order_long(s, d), "value", 8, 1, by=("series",))
)
query("analysis_stationarity")(lambda s, d: factors.stationarity_tests(order_long(s, d)))

for _n, _k, _c in (
    ("adf", econometrics.adf, ("statistic", "lags")), ("phillips_perron", econometrics.phillips_perron, ("statistic", "lags")),
    ("kpss_kernel", econometrics.kpss, ("statistic", "lags")), ("dfgls", econometrics.dfgls, ("statistic", "lags")),
    ("zivot_andrews", econometrics.zivot_andrews, ("statistic", "break_position")), ("ndiffs", econometrics.ndiffs, ("ndiffs",)),
    ("nsdiffs", econometrics.nsdiffs, ("nsdiffs",)),
):
    query(f"analysis_{_n}")(lambda s, d, k=_k, c=_c: econometrics.per_series(order_long(s, d), k, c))
query("analysis_pacf", L + f", e AS (SELECT series, date, value - avg(value) OVER (PARTITION BY series) AS e FROM olong WHERE value IS NOT NULL), r AS (SELECT series, sum(e * b) / sum(e * e) AS r1, sum(e * c) / sum(e * e) AS r2, count(*) AS n FROM (SELECT *, lag(e) OVER ({W}) AS b, lag(e, 2) OVER ({W}) AS c FROM e) GROUP BY 1) SELECT series, r1 AS pacf1, (r2 - r1 ^ 2) / (1 - r1 ^ 2) AS pacf2, n FROM r", "pacf1 pacf2")(
    lambda s, d: econometrics.per_series(order_long(s, d), lambda y: dict(zip(("pacf1", "pacf2"), econometrics.pacf(y, 2)[1:])), ("pacf1", "pacf2"))
)

# Interpretation.
_C = {"p2": 0.5, "p3": -0.25, "p4": 0.1}
query("interpret_linear_shap", L + "SELECT date, series AS feature, CASE series WHEN 'p2' THEN 0.5 WHEN 'p3' THEN -0.25 ELSE 0.1 END * (value - avg(value) OVER (PARTITION BY series)) AS shap FROM olong WHERE series IN ('p2', 'p3', 'p4')", "shap")(
    lambda s, d: interpret.shap_linear(order_panel(s, d), _C)
)
query("interpret_shap_importance", L + "SELECT feature, avg(abs(shap)) AS importance FROM (SELECT date, series AS feature, CASE series WHEN 'p2' THEN 0.5 WHEN 'p3' THEN -0.25 ELSE 0.1 END * (value - avg(value) OVER (PARTITION BY series)) AS shap FROM olong WHERE series IN ('p2', 'p3', 'p4')) GROUP BY 1", "importance")(
    lambda s, d: interpret.shapley_variable_importance(interpret.shap_linear(order_panel(s, d), _C))
)
query("interpret_decomposition", L + "SELECT date, series AS feature, CASE series WHEN 'p2' THEN 0.5 WHEN 'p3' THEN -0.25 ELSE 0.1 END * value AS contribution FROM olong WHERE series IN ('p2', 'p3', 'p4')", "contribution")(
    lambda s, d: interpret.forecast_decomposition(order_panel(s, d), _C)
)
query("interpret_group_aggregate", L + "SELECT date, CASE WHEN series IN ('p2', 'p3') THEN 'a' ELSE 'other' END AS \"group\", sum(CASE series WHEN 'p2' THEN 0.5 WHEN 'p3' THEN -0.25 ELSE 0.1 END * value) AS contribution FROM olong WHERE series IN ('p2', 'p3', 'p4') GROUP BY 1, 2", "contribution")(
    lambda s, d: interpret.group_aggregate(interpret.forecast_decomposition(order_panel(s, d), _C), {"p2": "a", "p3": "a"}, "contribution", ("date",))
)


def _weights(s, d):
    """Observation weights proportional to the value of each priority in each month."""
    from pyspark.sql import Window

    w = F.col("value") / F.sum("value").over(Window.partitionBy("date"))
    return order_long(s, d).select("date", F.col("series").alias("source_date"), (w - 0.15).alias("weight"))


_WT = L + ", w AS (SELECT date, series AS source_date, value / sum(value) OVER (PARTITION BY date) - 0.15 AS weight FROM olong)"
query("interpret_top_observations", _WT + " SELECT *, CAST(row_number() OVER (PARTITION BY date ORDER BY abs(weight) DESC, source_date) AS INT) AS rank FROM w QUALIFY rank <= 2", "weight")(
    lambda s, d: interpret.top_observations(_weights(s, d), 2)
)
query("interpret_weight_diagnostics", _WT + ", t AS (SELECT *, abs(weight - lag(weight) OVER (PARTITION BY source_date ORDER BY date)) AS d FROM w) SELECT date, sum(weight ^ 2) AS hhi, sum(abs(weight)) AS leverage, sum(greatest(-weight, 0)) AS short, sum(weight) AS total, sum(d) AS turnover FROM t GROUP BY 1", "hhi leverage short total turnover")(
    lambda s, d: interpret.data_portfolio_diagnostics(_weights(s, d))
)


def _attention(s, d):
    """Weights of the first sixty complete months in the predictions of the later ones."""
    import pandas as pd

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("date")[_X].to_numpy(float)
        w = interpret.ols_attention_weights(x[:60], x[60:], 1e-8)
        i, j = np.indices(w.shape)
        return pd.DataFrame({"test_row": i.ravel(), "train_row": j.ravel(), "weight": w.ravel()})

    return _features(s, d).select("date", *_X).groupBy().applyInPandas(work, "test_row int, train_row int, weight double")


query("interpret_attention_weights")(_attention)

# Event panels: the batch form of the streaming queries.
query("events_tumbling_panel", "SELECT date_trunc('hour', ts) AS start, event_type, sum(value) AS total, avg(value) AS mean, count(*) AS n FROM events GROUP BY 1, 2", "total mean")(
    lambda s, d: table(s, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("start"), "event_type").agg(F.sum("value").alias("total"), F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
)
query("events_sessions", """WITH e AS (SELECT user_id, ts, value, (ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR) IS NOT TRUE AS new FROM events),
s AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts, value ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS start, count(*) AS n, sum(value) AS total FROM s GROUP BY user_id, k""", "total")(
    lambda s, d: table(s, d, "events").groupBy(F.session_window(F.col("ts").cast("timestamp"), "6 hours"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    .select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n", "total")
)
