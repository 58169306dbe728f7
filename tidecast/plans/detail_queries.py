"""Splitters, window rules, recipes, shifts, traces and tables that the larger queries only use in part."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import analysis, clean, diagnostics, features, interpret, metrics, panel, windows
from ..sources import sinks
from .bases import FORECAST_SQL, ORDER_LONG_SQL, P, forecasts, order_long, order_panel
from .registry import query

X = f"WITH {FORECAST_SQL} "
L = f"WITH {ORDER_LONG_SQL} "
G = "target, horizon, model"
E = "(actual - prediction)"
WD = "PARTITION BY target, horizon, model ORDER BY date"
FOLD = "CAST({0} AS INT) AS fold, 0 AS train_start, CAST({1} AS INT) AS train_end, CAST({2} AS INT) AS val_start, CAST({3} AS INT) AS val_end"

# Splitters on a hundred rows.
query("window_last_block", "SELECT " + FOLD.format(0, 78, 80, 100))(lambda s, d: windows.split_table(s, "last_block", 100, embargo=2))
query("window_poos", "SELECT " + FOLD.format("i - 75", "i - 1", "i", "i + 1") + " FROM range(75, 100) t(i)")(lambda s, d: windows.split_table(s, "poos", 100, embargo=1))
query("window_rolling_blocks", "SELECT " + FOLD.format("b", "40 + 20 * b", "40 + 20 * b", "60 + 20 * b") + " FROM range(3) t(b)")(lambda s, d: windows.split_table(s, "rolling_blocks", 100))
query("window_random_kfold", "SELECT CAST(k AS INT) AS fold, 80 AS n_train, 20 AS n_val, 0 AS n_both FROM range(5) t(k)")(
    lambda s, d: s.createDataFrame([(i, len(a), len(b), len({*a} & {*b})) for i, (a, b) in enumerate(windows.make_splitter("random_kfold", 100))], "fold int, n_train int, n_val int, n_both int")
)

# Window rules.
_ORIGIN = "SELECT CAST(o AS INT) AS origin_pos, {start} AS fit_start, {end} AS fit_end, CAST(o AS INT) AS test_start, CAST(o AS INT) AS test_end, {retrain} AS retrain, {retrain} AS retune FROM range({first}, 79) t(o)"
query("window_expanding_origins", _ORIGIN.format(start="0", end="CAST(o - 3 AS INT)", retrain="true", first=26))(
    lambda s, d: windows.origins(s, 79, windows.spec(windows.estimation_expanding(min_size=24, embargo=2)))
)
query("window_fixed_origins", _ORIGIN.format(start="0", end="40", retrain="(o - 50) % 4 = 0", first=50))(
    lambda s, d: windows.origins(s, 79, windows.spec(windows.estimation_fixed(40, retrain_every=4), None, windows.test_origins(first_origin=50)))
)
query("window_calendar_origins", L + ", n AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM wide) SELECT CAST(pos AS INT) AS origin_pos, 0 AS fit_start, CAST(pos - 1 AS INT) AS fit_end, CAST(pos AS INT) AS test_start, CAST(pos AS INT) AS test_end, true AS retrain, true AS retune FROM n WHERE date BETWEEN DATE '2000-01-01' AND DATE '2000-12-01'")(
    lambda s, d: windows.origins(s, order_panel(s, d).count(), windows.from_cutoffs(order_panel(s, d), "2000-01-01", "2000-12-01"))
)
for _scope, _cond in {"estimation": "pos <= o - 1", "origin_available": "pos <= o", "full_panel": "true"}.items():
    query(f"window_scope_{_scope}", L + f", n AS (SELECT date, p1, row_number() OVER (ORDER BY date) - 1 AS pos FROM wide) SELECT CAST(o AS INT) AS origin_pos, count(*) AS n, sum(p1) AS total FROM range(30, 60, 10) t(o) JOIN n ON {_cond} GROUP BY 1", "total")(
        lambda s, d, k=_scope: windows.stage_panel(order_panel(s, d), windows.origins(s, 60, windows.spec(windows.estimation_expanding(min_size=24), None, windows.test_origins(first_origin=30, step=10))), windows.stage_policy(k))
        .groupBy("origin_pos").agg(F.count(F.lit(1)).alias("n"), F.sum("p1").alias("total"))
    )
query("window_scope_reference", L + " SELECT CAST(o AS INT) AS origin_pos, count(*) AS n, sum(p1) AS total FROM range(30, 60, 10) t(o), wide WHERE date BETWEEN DATE '1996-01-01' AND DATE '1997-12-01' GROUP BY 1", "total")(
    lambda s, d: windows.stage_panel(order_panel(s, d), windows.origins(s, 60, windows.spec(windows.estimation_expanding(min_size=24), None, windows.test_origins(first_origin=30, step=10))), windows.stage_policy("fixed_reference", reference=("1996-01-01", "1997-12-01")))
    .groupBy("origin_pos").agg(F.count(F.lit(1)).alias("n"), F.sum("p1").alias("total"))
)
for _update, _fit in {"every_k": "o - (o - 30) % 4", "never": "30", "every_origin": "o", "on_retrain": "o - (o - 30) % 5"}.items():
    query(f"window_updates_{_update}", f"SELECT CAST(o AS INT) AS origin_pos, CAST({_fit} AS INT) AS stage_fit FROM range(30, 60) t(o)")(
        lambda s, d, u=_update: windows.stage_updates(windows.origins(s, 60, windows.spec(windows.estimation_expanding(retrain_every=5), None, windows.test_origins(first_origin=30))), windows.stage_policy(update=u, every=4)).select("origin_pos", "stage_fit")
    )
query("window_alignment", L + " SELECT date, p1, lead(p2) OVER (ORDER BY date) AS y FROM wide QUALIFY p1 + y IS NOT NULL", "p1 y")(
    lambda s, d: windows.alignment_drop_incomplete().align(order_panel(s, d).select("date", "p1"), order_panel(s, d).select("date", F.lead("p2").over(Window.orderBy("date")).alias("y")))
)

# Panels and cleaning.
query("panel_spec", L + " SELECT date, p1, p2, p3, p4, p5 FROM wide WHERE date BETWEEN DATE '1996-01-01' AND DATE '1999-12-01'", " ".join(P))(
    lambda s, d: panel.spec(order_panel(s, d), ["p1"], (1,), "1996-01-01", "1999-12-01").panel
)
query("panel_validated", L + " SELECT * FROM wide", " ".join(P))(lambda s, d: panel.validate_panel(order_panel(s, d)))
query("panel_static_extras", L + " SELECT coalesce(a.date, b.date) AS date, p1, p2 FROM (SELECT date, p1 FROM wide WHERE date < DATE '1999-01-01') a FULL JOIN (SELECT date, p2 FROM wide WHERE date >= DATE '1998-01-01') b USING (date) WHERE coalesce(a.date, b.date) <= DATE '2000-01-01'", "p1 p2")(
    lambda s, d: panel.with_static_extras(order_panel(s, d).select("date", "p1").where("date < '1999-01-01'"), order_panel(s, d).select("date", "p2").where("date >= '1998-01-01'"), "2000-01-01")
)
query("clean_box_cox", L + " SELECT date, (p1 ^ 0.5 - 1) / 0.5 AS half, ln(p1) AS log, p1 AS back FROM wide WHERE p1 > 0", "half log back")(
    lambda s, d: order_panel(s, d).where("p1 > 0").select("date", clean.box_cox(F.col("p1"), 0.5).alias("half"), clean.box_cox(F.col("p1"), 0.0).alias("log"), clean.inverse_box_cox(clean.box_cox(F.col("p1"), 0.5), 0.5).alias("back"))
)
query("clean_report", L + " SELECT series, count(value) AS n, count(*) - count(value) AS n_missing, avg(value) AS mean, stddev_samp(value) AS sd, min(date) FILTER (value IS NOT NULL) AS first, max(date) FILTER (value IS NOT NULL) AS last FROM olong GROUP BY 1", "mean sd")(
    lambda s, d: clean.report(order_panel(s, d))
)
_MEAN = lambda c: f"CASE WHEN count({c}) OVER (ORDER BY date ROWS 2 PRECEDING) = 3 THEN avg({c}) OVER (ORDER BY date ROWS 2 PRECEDING) END"
query("features_build", L + f" SELECT date, p1, p2, lag(p1) OVER w AS p1_lag1, lag(p2) OVER w AS p2_lag1, {_MEAN('p1')} AS p1_mean3, {_MEAN('p2')} AS p2_mean3, lead(p1) OVER w AS p1_level_h1 FROM wide WINDOW w AS (ORDER BY date) QUALIFY p1 + p2 + p1_lag1 + p2_lag1 + p1_mean3 + p2_mean3 + p1_level_h1 IS NOT NULL", "p1 p2 p1_lag1 p2_lag1 p1_mean3 p2_mean3 p1_level_h1")(
    lambda s, d: features.build_features(order_panel(s, d).select("date", "p1", "p2"), "p1")
)
query("features_composed", L + " SELECT date, p1, lag(p1) OVER w AS p1_lag1, p1 - lag(p1) OVER w AS p1_diff1 FROM wide WINDOW w AS (ORDER BY date) QUALIFY p1 + p1_lag1 IS NOT NULL", "p1 p1_lag1 p1_diff1")(
    lambda s, d: features.compose_features(order_panel(s, d).select("date", "p1"), [features.lag_step(columns=["p1"]), features.custom_step(lambda df: df.withColumn("p1_diff1", F.col("p1") - F.col("p1_lag1")))], True)
)

# Shifts between a raw and a cleaned panel.
_CLEAN = L + ", cl AS (SELECT date, series, CASE WHEN value <= 1.5 * avg(value) OVER (PARTITION BY series) THEN value END AS value FROM olong)"


def _shifted(s, d):
    long = order_long(s, d)
    w = Window.partitionBy("series")
    return long, long.withColumn("value", F.when(F.col("value") <= 1.5 * F.avg("value").over(w), F.col("value")))


_PAIR = "(SELECT a.series AS a, b.series AS b, corr(a.value, b.value) AS r FROM {0} a JOIN {0} b ON a.date = b.date AND a.series < b.series WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY 1, 2)"
query("analysis_correlation_shift", _CLEAN + f" SELECT a, b, c.r - r.r AS shift FROM {_PAIR.format('olong')} r JOIN {_PAIR.format('cl')} c USING (a, b)", "shift")(
    lambda s, d: analysis.correlation_shift(*_shifted(s, d))
)
query("diagnostic_feature_correlation", L + f" SELECT a, b, r AS corr FROM {_PAIR.format('olong')} WHERE abs(r) >= 0.05", "corr")(
    lambda s, d: diagnostics.feature_correlation(order_long(s, d), 0.05).select("a", "b", "corr")
)
query("diagnostic_target_correlation", L + ", t AS (SELECT date, value AS y FROM olong WHERE series = 'p1') SELECT series, corr(value, y) AS corr, count(*) AS n FROM olong JOIN t USING (date) WHERE value IS NOT NULL AND y IS NOT NULL GROUP BY 1", "corr")(
    lambda s, d: diagnostics.feature_target_correlation(order_long(s, d), order_panel(s, d).select("date", F.col("p1").alias("y")))
)

# Traces and weights.
query("diagnostic_fitted_vs_actual", X + " SELECT *, actual - prediction AS residual FROM fc WHERE actual IS NOT NULL", "prediction actual residual")(lambda s, d: diagnostics.fitted_vs_actual(forecasts(s, d)))
query("diagnostic_scale_view", X + ", lv AS (SELECT series AS target, date AS origin, value AS level FROM olong) SELECT target, horizon, model, date, prediction, level + prediction AS prediction_level FROM fc JOIN lv USING (target, origin)", "prediction prediction_level")(
    lambda s, d: diagnostics.forecast_scale_view(forecasts(s, d), order_long(s, d).select(F.col("series").alias("target"), "date", F.col("value").alias("level"))).select("target", "horizon", "model", "date", "prediction", "prediction_level")
)
query("metrics_acf1", X + f", e AS (SELECT {G}, date, {E} - avg({E}) OVER (PARTITION BY {G}) AS e FROM fc WHERE {E} IS NOT NULL), l AS (SELECT *, lag(e) OVER ({WD}) AS b FROM e) SELECT {G}, sum(e * b) / nullif(sum(e * e), 0) AS acf1 FROM l GROUP BY ALL", "acf1")(
    lambda s, d: metrics.acf1(forecasts(s, d).withColumn("e", F.col("actual") - F.col("prediction")).where("e IS NOT NULL"), "e", ("target", "horizon", "model"))
)


def _selections(s, d):
    """At every origin the two models of least absolute error, as if they had been selected."""
    w = Window.partitionBy("target", "horizon", "origin").orderBy(F.abs(F.col("actual") - F.col("prediction")), "model")
    f = forecasts(s, d).where("actual IS NOT NULL AND prediction IS NOT NULL").withColumn("r", F.row_number().over(w)).where("r <= 2")
    return f.select("target", F.lit("arm").alias("arm"), "horizon", "origin", F.lit("model").alias("kind"), F.col("model").alias("name"))


_SEL = X + f", s AS (SELECT target, horizon, origin, model AS name FROM fc WHERE {E} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY target, horizon, origin ORDER BY abs{E}, model) <= 2)"
query("selection_frequency", _SEL + ", t AS (SELECT horizon, count(DISTINCT origin) AS n_origins FROM s GROUP BY 1) SELECT 'arm' AS arm, horizon, 'model' AS kind, name, count(DISTINCT origin) AS n_selected, max(n_origins) AS n_origins, count(DISTINCT origin) / max(n_origins) AS frequency FROM s JOIN t USING (horizon) GROUP BY horizon, name", "frequency")(
    lambda s, d: diagnostics.selection_frequency_table(_selections(s, d))
)
query("selection_stability", _SEL + " SELECT name AS feature, count(DISTINCT origin) AS n, count(DISTINCT origin) / (SELECT count(DISTINCT origin) FROM s) AS frequency FROM s GROUP BY 1", "frequency")(
    lambda s, d: diagnostics.selection_stability(_selections(s, d).select(F.col("origin").alias("run"), F.col("name").alias("feature")))
)


def _lag_weights(s, d):
    """Weights 1, 1/2, ... of the eight months before each month."""
    n = order_panel(s, d).select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("pos"))
    return n.select("date", "pos", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")).where("pos >= 7").select("date", "pos", (F.col("pos") - F.col("k")).alias("source_pos"), (1 / (1 + F.col("k"))).alias("weight"))


_LW = L + ", n AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM wide), lw AS (SELECT date, k, 1 / (1 + k) AS weight FROM n, range(8) t(k) WHERE pos >= 7)"
query("diagnostic_effective_window", _LW + " SELECT date, count(*) FILTER (weight > 0.2) AS effective_window FROM lw GROUP BY 1")(lambda s, d: diagnostics.effective_window(_lag_weights(s, d), 0.2))
query("diagnostic_recent_weight", _LW + " SELECT date, sum(weight) FILTER (k = 0) AS lag_0, sum(weight) FILTER (k BETWEEN 1 AND 2) AS lag_1_2, sum(weight) FILTER (k BETWEEN 3 AND 5) AS lag_3_5, sum(weight) FILTER (k >= 6) AS lag_6_plus, 0.0::DOUBLE AS future FROM lw GROUP BY 1", "lag_0 lag_1_2 lag_3_5 lag_6_plus future")(
    lambda s, d: diagnostics.recent_weight_share(_lag_weights(s, d))
)


def _tagged(s, d):
    f = metrics.evaluate_forecasts(forecasts(s, d), ("target", "horizon", "model"), ["mse"])
    return f.withColumns({"r2": 1 - F.col("mse"), "means": F.col("model").isin("hist_mean", "ma3").cast("double"), "walks": F.col("model").isin("naive", "drift").cast("double")})


query("diagnostic_axis_contribution", X + f""", m AS (SELECT {G}, 1 - avg({E} ^ 2) AS r2 FROM fc GROUP BY ALL), t AS (SELECT *, unnest(['means', 'walks']) AS tag FROM m), u AS (SELECT *, CASE WHEN tag = 'means' THEN (model IN ('hist_mean', 'ma3'))::INT ELSE (model IN ('naive', 'drift'))::INT END AS x FROM t),
w AS (SELECT tag, r2 - avg(r2) OVER p AS y, x - avg(x) OVER p AS x FROM u WINDOW p AS (PARTITION BY tag, target, horizon)) SELECT tag, sum(x * y) / sum(x * x) AS effect, count(*) AS n FROM w GROUP BY 1""", "effect")(
    lambda s, d: diagnostics.axis_contribution(_tagged(s, d), ["means", "walks"])
)
query("checkpoint_records", X + " SELECT target, horizon, origin, origin_pos, date, model, prediction, actual FROM fc", "prediction actual")(lambda s, d: sinks.lean_records(forecasts(s, d)))


def _importance(s, d, seed):
    return metrics.evaluate_forecasts(forecasts(s, d).where(f"horizon = {seed}"), ("model",), ["mse"]).select(F.col("model").alias("feature"), F.col("mse").alias("importance"))


query("interpret_model_accordance", X + f", a AS (SELECT model, avg({E} ^ 2) FILTER (horizon = 1) AS x, avg({E} ^ 2) FILTER (horizon = 3) AS y FROM fc GROUP BY 1) SELECT corr(x, y) AS accordance, sum(x * y) / sqrt(sum(x * x) * sum(y * y)) AS cosine FROM a", "accordance cosine")(
    lambda s, d: interpret.model_accordance(_importance(s, d, 1), _importance(s, d, 3))
)
query("interpret_concentration", X + f", a AS (SELECT model AS feature, avg({E} ^ 2) AS importance FROM fc WHERE horizon = 1 GROUP BY 1) SELECT feature, importance, importance / sum(importance) OVER () AS share, sum(importance) OVER (ORDER BY importance) / sum(importance) OVER () AS cumulative FROM a", "importance share cumulative")(
    lambda s, d: interpret.concentration(_importance(s, d, 1))
)
query("interpret_outcome_contributions", L + ", w AS (SELECT date, series AS source_date, value / sum(value) OVER (PARTITION BY date) AS weight FROM olong), y AS (SELECT series AS source_date, avg(value) AS y FROM olong GROUP BY 1) SELECT date, source_date, weight, y, weight * y AS contribution FROM w JOIN y USING (source_date)", "weight y contribution")(
    lambda s, d: interpret.outcome_contributions(
        order_long(s, d).select("date", F.col("series").alias("source_date"), (F.col("value") / F.sum("value").over(Window.partitionBy("date"))).alias("weight")),
        order_long(s, d).groupBy(F.col("series").alias("source_date")).agg(F.avg("value").alias("y")),
    )
)
query("evaluate_report_scores", X + f" SELECT {G}, avg({E} ^ 2) AS mse, sqrt(avg({E} ^ 2)) AS rmse, avg(abs{E}) AS mae, count(*) FILTER ({E} IS NOT NULL) AS n FROM fc GROUP BY ALL", "mse rmse mae")(
    lambda s, d: metrics.evaluate_report(forecasts(s, d), "naive")["scores"]
)
