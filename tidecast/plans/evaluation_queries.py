"""Forecasts, accuracy, combinations, tests and forecast diagnostics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import combine, diagnostics, metrics
from ..operators import tests_stat as tests
from .bases import FORECAST_SQL, forecasts
from .registry import query

X = f"WITH {FORECAST_SQL} "
G = "target, horizon, model"
OK = "actual IS NOT NULL AND prediction IS NOT NULL"
E = "(actual - prediction)"
#: Rows shared with the benchmark.
B = X + f", j AS (SELECT f.*, b.prediction AS bench FROM fc f JOIN (SELECT target, horizon, date, prediction FROM fc WHERE model = 'naive') b USING (target, horizon, date) WHERE f.actual IS NOT NULL AND f.prediction IS NOT NULL AND b.prediction IS NOT NULL)"
D = B + ", d AS (SELECT *, (actual - prediction) ^ 2 - (actual - bench) ^ 2 AS d FROM j WHERE model <> 'naive' QUALIFY count(*) OVER (PARTITION BY target, horizon, model) >= 8)"
WG = "PARTITION BY target, horizon, model"
WD = f"{WG} ORDER BY date"

query("forecast_table", X + "SELECT * FROM fc", "prediction actual")(forecasts)
_ACC = B + f", a AS (SELECT {G}, avg({E} ^ 2) AS m, avg((actual - bench) ^ 2) AS b, avg(abs{E}) AS am, avg(abs(actual - bench)) AS ab, count(*) AS n FROM j GROUP BY ALL)"
query("accuracy_benchmark", _ACC + f" SELECT {G}, sqrt(m) AS rmse, CASE WHEN b > 0 THEN m / b END AS relative_mse, am / nullif(ab, 0) AS relative_mae, b - m AS mse_reduction, 1 - CASE WHEN b > 0 THEN m / b END AS r2_oos, n FROM a", "rmse relative_mse relative_mae mse_reduction r2_oos")(
    lambda s, d: metrics.benchmark_comparison(forecasts(s, d), "naive")
)


@query("flagship_accuracy", _ACC + f" SELECT {G}, sqrt(m) AS rmse, CASE WHEN b > 0 THEN m / b END AS relative_mse, 1 - CASE WHEN b > 0 THEN m / b END AS r2_oos, n, CAST(rank() OVER (PARTITION BY target, horizon ORDER BY m) AS INT) AS rank FROM a", "rmse relative_mse r2_oos")
def flagship(spark, sf_dir):
    """Orders to monthly panel to forecasts to accuracy against the naive forecast to ranks."""
    scores = metrics.benchmark_comparison(forecasts(spark, sf_dir), "naive")
    return metrics.rank_forecasts(scores, "rmse", ("target", "horizon")).select("target", "horizon", "model", "rmse", "relative_mse", "r2_oos", "n", "rank")


query("metrics_point", X + f"""SELECT {G}, avg({E} ^ 2) AS mse, sqrt(avg({E} ^ 2)) AS rmse, avg(abs{E}) AS mae, avg{E} AS bias, median(abs{E}) AS medae,
  avg(abs{E} / abs(actual)) * 100 AS mape, avg(abs{E} / ((abs(actual) + abs(prediction)) / 2)) * 100 AS smape,
  sqrt(avg({E} ^ 2)) / (sqrt(avg(actual ^ 2) FILTER ({OK})) + sqrt(avg(prediction ^ 2) FILTER ({OK}))) AS theil_u1, count(*) FILTER ({OK}) AS n FROM fc GROUP BY ALL""", "mse rmse mae bias medae mape smape theil_u1")(
    lambda s, d: metrics.evaluate_forecasts(forecasts(s, d), ("target", "horizon", "model"), list(metrics.POINT))
)
query("metrics_mad", X + f"SELECT model, horizon, median(abs(e - m)) AS mad FROM (SELECT model, horizon, {E} AS e, median{E} OVER (PARTITION BY model, horizon) AS m FROM fc) GROUP BY ALL", "mad")(
    lambda s, d: metrics.mad(forecasts(s, d))
)


def _directed(s, d):
    w = Window.partitionBy("target", "horizon", "model").orderBy("date")
    return forecasts(s, d).withColumn("previous_actual", F.lag("actual", 1).over(w))


query("metrics_direction", X + f""", p AS (SELECT *, lag(actual) OVER ({WD}) AS prev FROM fc), q AS (SELECT *, ((prediction - actual) / nullif(prev, 0)) ^ 2 AS own, ((actual - prev) / nullif(prev, 0)) ^ 2 AS nav FROM p)
SELECT {G}, avg({E} ^ 2) AS mse, CASE WHEN count(sign(prediction - prev) = sign(actual - prev)) >= 2 THEN avg((sign(prediction - prev) = sign(actual - prev))::INT) END AS success_ratio,
  sqrt(sum(own) FILTER (nav IS NOT NULL) / nullif(sum(nav) FILTER (own IS NOT NULL), 0)) AS theil_u2, count(*) FILTER ({OK}) AS n FROM q GROUP BY ALL""", "mse success_ratio theil_u2")(
    lambda s, d: metrics.evaluate_forecasts(_directed(s, d), ("target", "horizon", "model"), ["mse"])
)


def _density(s, d):
    """A variance known a date before and a 90 % interval."""
    w = Window.partitionBy("target", "horizon", "model").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    f = forecasts(s, d)
    v = f.withColumn("variance_prediction", F.avg(F.pow(F.col("actual") - F.col("prediction"), 2)).over(w)).where("variance_prediction > 0")
    half = 1.645 * F.sqrt("variance_prediction")
    return v.withColumns({"lower": F.col("prediction") - half, "upper": F.col("prediction") + half})


V = X + f", v0 AS (SELECT *, avg({E} ^ 2) OVER ({WD} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS v FROM fc), v AS (SELECT *, prediction - 1.645 * sqrt(v) AS lo, prediction + 1.645 * sqrt(v) AS hi FROM v0 WHERE v > 0)"
query("metrics_density", V + f" SELECT {G}, avg({E} ^ 2) AS mse, avg(0.5 * (ln(2 * pi() * v) + {E} ^ 2 / v)) AS negative_log_score, avg(ln(greatest(v, 1e-12)) + actual ^ 2 / greatest(v, 1e-12)) AS qlike, count(*) FILTER ({OK}) AS n FROM v GROUP BY ALL", "mse negative_log_score qlike")(
    lambda s, d: metrics.evaluate_forecasts(_density(s, d), ("target", "horizon", "model"), ["mse"])
)
query("metrics_interval", V + f" SELECT {G}, avg((actual BETWEEN lo AND hi)::INT) AS coverage, avg(hi - lo) AS width, avg(CASE WHEN actual IS NOT NULL THEN hi - lo + 20 * (CASE WHEN actual < lo THEN lo - actual ELSE 0 END + CASE WHEN actual > hi THEN actual - hi ELSE 0 END) END) AS score FROM v GROUP BY ALL", "coverage width score")(
    lambda s, d: _density(s, d).groupBy("target", "horizon", "model").agg(metrics.coverage_rate().alias("coverage"), metrics.interval_width().alias("width"), metrics.interval_score(alpha=0.1).alias("score"))
)
query("metrics_pinball", X + f"SELECT {G}, avg(greatest(0.9 * {E}, -0.1 * {E})) AS pinball FROM fc GROUP BY ALL", "pinball")(
    lambda s, d: forecasts(s, d).groupBy("target", "horizon", "model").agg(metrics.pinball_loss(0.9).alias("pinball"))
)
query("metrics_crps")(lambda s, d: _density(s, d).withColumn("c", metrics.crps_row()).groupBy("target", "horizon", "model").agg(F.avg("c").alias("crps")))
_RET = B + ", r AS (SELECT target, horizon, model, date, (actual - bench) ^ 2 - (actual - prediction) ^ 2 AS r FROM j WHERE model <> 'naive')"
query("metrics_forecast_returns", _RET + " SELECT target, horizon, model, date, r AS forecast_return FROM r", "forecast_return")(lambda s, d: metrics.forecast_returns(forecasts(s, d), "naive"))
query("metrics_risk_adjusted", _RET + f""", c AS (SELECT *, sum(r) OVER ({WD} ROWS UNBOUNDED PRECEDING) AS c FROM r), m AS (SELECT *, c - max(c) OVER ({WD} ROWS UNBOUNDED PRECEDING) AS dd FROM c)
SELECT {G}, avg(r) / nullif(stddev_samp(r), 0) AS sharpe_ratio, avg(r) / nullif(sqrt(avg(least(r, 0) ^ 2)), 0) AS sortino_ratio, sum(greatest(r, 0)) / nullif(sum(greatest(-r, 0)), 0) AS omega_ratio, min(dd) AS max_drawdown, count(*) AS n FROM m GROUP BY ALL""", "sharpe_ratio sortino_ratio omega_ratio max_drawdown")(
    lambda s, d: metrics.risk_adjusted_forecast_metrics(metrics.forecast_returns(forecasts(s, d), "naive"))
)
query("metrics_edge_ratio", X + f""", l AS (SELECT *, {E} ^ 2 AS l FROM fc WHERE {OK}), t AS (SELECT target, horizon, date, list_sort(list(l)) AS two, count(*) AS m FROM l GROUP BY 1, 2, 3),
e AS (SELECT l.*, m, CASE WHEN l.l > two[1] THEN two[1] ELSE two[2] END - l.l AS e FROM l JOIN t USING (target, horizon, date) WHERE m > 1)
SELECT {G}, sum(greatest(e, 0)) / nullif(sum(greatest(-e, 0)), 0) * (max(m) - 1) AS edge_ratio FROM e GROUP BY ALL""", "edge_ratio")(lambda s, d: metrics.edge_ratio(forecasts(s, d)))
query("metrics_error_decomposition", X + f"SELECT {G}, avg({E} ^ 2) AS mse, avg{E} ^ 2 AS bias_sq, var_pop{E} AS variance, count{E} AS n, avg{E} ^ 2 / nullif(avg({E} ^ 2), 0) AS bias_share, var_pop{E} / nullif(avg({E} ^ 2), 0) AS variance_share FROM fc GROUP BY ALL", "mse bias_sq variance bias_share variance_share")(
    lambda s, d: metrics.error_decomposition(forecasts(s, d))
)
query("metrics_rollup", X + f"SELECT target, CAST(horizon AS VARCHAR) AS horizon, model, CAST(grouping_id(target, horizon, model) AS INT) AS level, avg({E} ^ 2) AS mse, avg(abs{E}) AS mae, count{E} AS n FROM fc GROUP BY ROLLUP (target, horizon, model)", "mse mae")(
    lambda s, d: metrics.grouping_sets_scores(forecasts(s, d)).withColumn("horizon", F.col("horizon").cast("string"))
)
query("metrics_regime", X + f"SELECT model, horizon, (date >= DATE '1999-01-01')::INT AS regime, avg({E} ^ 2) AS mse, avg(abs{E}) AS mae, count(*) FILTER ({OK}) AS n FROM fc GROUP BY ALL", "mse mae")(
    lambda s, d: metrics.regime_scores(forecasts(s, d), forecasts(s, d).select("date").distinct().withColumn("regime", (F.col("date") >= F.lit("1999-01-01").cast("date")).cast("int")))
)
query("metrics_rank", X + f", e AS (SELECT model, horizon, avg({E} ^ 2) AS mse, sqrt(avg({E} ^ 2)) AS rmse, avg(abs{E}) AS mae, count(*) FILTER ({OK}) AS n FROM fc GROUP BY 1, 2) SELECT *, CAST(rank() OVER (PARTITION BY horizon ORDER BY mse) AS INT) AS rank FROM e", "mse rmse mae")(
    lambda s, d: metrics.rank_forecasts(metrics.evaluate_forecasts(forecasts(s, d)))
)
query("metrics_mase", X + f""", y AS (SELECT DISTINCT target, date, actual FROM fc), sc AS (SELECT target, avg(abs(d)) AS scale FROM (SELECT target, actual - lag(actual, 12) OVER (PARTITION BY target ORDER BY date) AS d FROM y) GROUP BY 1)
SELECT {G}, mae / nullif(scale, 0) AS mase FROM (SELECT {G}, avg(abs{E}) AS mae FROM fc GROUP BY ALL) JOIN sc USING (target)""", "mase")(
    lambda s, d: metrics.mase(forecasts(s, d), metrics.seasonal_naive_mae(forecasts(s, d).select("target", "date", "actual").distinct(), "actual", 12, ("target",)))
)
query("oos_period", X + "SELECT * FROM fc WHERE date BETWEEN DATE '1999-01-01' AND DATE '2000-06-01'", "prediction actual")(
    lambda s, d: metrics.filter_oos_period(forecasts(s, d), "1999-01-01", "2000-06-01")
)

# Combinations.
_AT = "target, horizon, date"
for _m, _e in {"mean": "avg(prediction)", "median": "median(prediction)"}.items():
    query(f"combine_{_m}", X + f"SELECT {_AT}, max(actual) AS actual, {_e} AS prediction, 'comb_{_m}' AS model FROM fc WHERE prediction IS NOT NULL GROUP BY ALL", "actual prediction")(
        lambda s, d, m=_m: combine.METHODS[m](forecasts(s, d))
    )
query("combine_trimmed_mean", X + f", r AS (SELECT *, row_number() OVER (PARTITION BY {_AT} ORDER BY prediction) AS i, count(*) OVER (PARTITION BY {_AT}) AS m FROM fc WHERE prediction IS NOT NULL) SELECT {_AT}, max(actual) AS actual, avg(prediction) AS prediction, 'comb_trimmed' AS model FROM r WHERE i > floor(0.2 * m) AND i <= m - floor(0.2 * m) GROUP BY {_AT}", "actual prediction")(
    lambda s, d: combine.combine_trimmed_mean(forecasts(s, d), 0.2)
)
query("combine_winsorized_mean", X + f", q AS (SELECT *, quantile_cont(prediction, .1) OVER w AS lo, quantile_cont(prediction, .9) OVER w AS hi FROM fc WHERE prediction IS NOT NULL WINDOW w AS (PARTITION BY {_AT})) SELECT {_AT}, max(actual) AS actual, avg(least(greatest(prediction, lo), hi)) AS prediction, 'comb_winsorized' AS model FROM q GROUP BY {_AT}", "actual prediction")(
    lambda s, d: combine.combine_winsorized_mean(forecasts(s, d))
)
_H = X + f", g AS (SELECT {_AT}, max(actual) AS actual FROM fc GROUP BY ALL), ms AS (SELECT DISTINCT target, horizon, model FROM fc), fu AS (SELECT g.target, g.horizon, g.date, g.actual, ms.model, f.prediction, (g.actual - f.prediction) ^ 2 AS e2 FROM g JOIN ms USING (target, horizon) LEFT JOIN fc f USING (target, horizon, date, model)), h AS (SELECT *, sum(e2) OVER w AS hs, avg(e2) OVER w AS ha FROM fu WINDOW w AS ({WD} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), hp AS (SELECT * FROM h WHERE prediction IS NOT NULL)"
query("combine_inverse_mspe", _H + f", w AS (SELECT *, CASE WHEN min((hs IS NOT NULL)::INT) OVER (PARTITION BY {_AT}) = 1 THEN 1 / greatest(hs, 1e-12) ELSE 1 END AS w FROM hp) SELECT {_AT}, max(actual) AS actual, sum(w * prediction) / sum(w) AS prediction, 'comb_inverse_mspe' AS model FROM w GROUP BY {_AT}", "actual prediction")(
    lambda s, d: combine.combine_inverse_mspe(forecasts(s, d))
)
query("combine_best_n", _H + f", w AS (SELECT *, row_number() OVER (PARTITION BY {_AT} ORDER BY ha NULLS LAST, model) AS r, max((ha IS NOT NULL)::INT) OVER (PARTITION BY {_AT}) AS known FROM hp) SELECT {_AT}, max(actual) AS actual, avg(prediction) AS prediction, 'comb_best_n' AS model FROM w WHERE known = 0 OR r <= 2 GROUP BY {_AT}", "actual prediction")(
    lambda s, d: combine.combine_best_n(forecasts(s, d), 2)
)
query("combine_dmspe")(lambda s, d: combine.combine_inverse_mspe(forecasts(s, d), 0.9))
query("combine_linear_pool", V + f" SELECT {_AT}, avg(prediction) AS prediction, avg(v + prediction ^ 2) - avg(prediction) ^ 2 AS variance_prediction FROM v GROUP BY ALL", "prediction variance_prediction")(
    lambda s, d: combine.combine_linear_pool(_density(s, d))
)
query("combine_log_pool", V + f" SELECT {_AT}, avg(prediction / v) / avg(1 / v) AS prediction, 1 / avg(1 / v) AS variance_prediction FROM v WHERE prediction IS NOT NULL GROUP BY ALL", "prediction variance_prediction")(
    lambda s, d: combine.combine_log_pool(_density(s, d).where("prediction IS NOT NULL"))
)
for _m in ("bates_granger", "granger_ramanathan", "constrained_ls", "eigenvector", "regularized"):
    query(f"combine_{_m}")(lambda s, d, m=_m: combine.METHODS[m](forecasts(s, d)))
query("apply_combinations", X + f"SELECT target, horizon, date, actual, prediction, model FROM fc UNION ALL SELECT {_AT}, max(actual), avg(prediction), 'comb_mean' FROM fc WHERE prediction IS NOT NULL GROUP BY 1, 2, 3 UNION ALL SELECT {_AT}, max(actual), median(prediction), 'comb_median' FROM fc WHERE prediction IS NOT NULL GROUP BY 1, 2, 3", "actual prediction")(
    lambda s, d: combine.apply_combinations(forecasts(s, d), ["mean", "median"])
)

# Tests.


def _hac(f, kernel):
    """mean, lrv, n of an expression over ``d`` with lags h - 1 (0 or 2 here)."""
    weight = lambda k: "1" if kernel == "acf" else f"(1 - {k} / horizon)"
    return f""", c AS (SELECT *, {f} - avg({f}) OVER ({WG}) AS cd, avg({f}) OVER ({WG}) AS cm FROM d), k AS (SELECT *, cd * lag(cd, 1) OVER ({WD}) AS p1, cd * lag(cd, 2) OVER ({WD}) AS p2 FROM c),
    s AS (SELECT {G}, max(cm) AS mean, count(*) AS n, sum(cd * cd) / count(*) AS g0, CASE WHEN horizon > 1 THEN 2 * {weight(1)} * sum(p1) / count(*) + 2 * {weight(2)} * sum(p2) / count(*) ELSE 0 END AS g FROM k GROUP BY target, horizon, model),
    h AS (SELECT *, CASE WHEN g0 + g <= 0 AND horizon > 1 THEN g0 ELSE g0 + g END AS lrv FROM s)"""


query("test_diebold_mariano", D + _hac("d", "acf") + f" SELECT {G}, n, mean / sqrt(CASE WHEN lrv > 0 THEN lrv END / n) * sqrt((n + 1 - 2 * horizon + horizon * (horizon - 1) / n) / n) AS statistic FROM h", "statistic")(
    lambda s, d: tests.dm_statistics(forecasts(s, d), "naive")
)
query("test_clark_west", D + _hac("((actual - bench) ^ 2 - (actual - prediction) ^ 2 + (bench - prediction) ^ 2)", "acf") + f" SELECT {G}, n, mean / sqrt(CASE WHEN lrv > 0 THEN lrv END / n) AS statistic FROM h", "statistic")(
    lambda s, d: tests.clark_west_statistics(forecasts(s, d), "naive")
)
query("test_encompassing", D + _hac("((actual - bench) * ((actual - bench) - (actual - prediction)))", "nw") + f", en AS (SELECT {G}, count(*) * avg((actual - bench) * ((actual - bench) - (actual - prediction))) / avg({E} ^ 2) AS enc_new FROM d GROUP BY ALL) SELECT {G}, n, enc_new, mean / sqrt(CASE WHEN lrv > 0 THEN lrv END / n) AS enc_t FROM h JOIN en USING (target, horizon, model)", "enc_new enc_t")(
    lambda s, d: tests.encompassing_statistics(forecasts(s, d), "naive")
)
for _n, _f in {"dm": lambda f: tests.dm_test(f, "naive"), "cw": lambda f: tests.clark_west_test(f, "naive"), "hn": lambda f: tests.harvey_newbold_test(f, "naive")}.items():
    query(f"test_{_n}_with_p_value")(lambda s, d, f=_f: f(forecasts(s, d)))


def _signed(s, d):
    """Changes from the last actual, so that signs mean something."""
    return _directed(s, d).where("previous_actual IS NOT NULL").withColumns({"actual": F.col("actual") - F.col("previous_actual"), "prediction": F.col("prediction") - F.col("previous_actual")})


_SG = X + f", sg AS (SELECT target, horizon, model, actual - p AS y, prediction - p AS f FROM (SELECT *, lag(actual) OVER ({WD}) AS p FROM fc) WHERE p IS NOT NULL AND actual IS NOT NULL AND prediction IS NOT NULL)"
query("test_directional", _SG + f""", a AS (SELECT {G}, count(*) AS n, avg((y > 0)::INT) AS py, avg((f > 0)::INT) AS px, avg(((y > 0) = (f > 0))::INT) AS s, avg((f > 0)::INT) FILTER (y > 0) AS up, avg((f <= 0)::INT) FILTER (y <= 0) AS dn, sum((y > 0)::INT) AS nu,
  avg(sign(f) * y) AS sy, avg(sign(f)) AS ms, avg(y) AS my, var_pop(y) * count(*) AS syy FROM sg GROUP BY ALL),
b AS (SELECT *, py * px + (1 - py) * (1 - px) AS st, ((2 * py - 1) ^ 2 * px * (1 - px) + (2 * px - 1) ^ 2 * py * (1 - py)) / n + 4 * py * px * (1 - py) * (1 - px) / (n * n) AS vs, 4 / (n * n) * (0.5 * (1 + ms)) * (1 - 0.5 * (1 + ms)) * syy AS va FROM a)
SELECT {G}, n, (s - st) / CASE WHEN st * (1 - st) / n - vs > 1e-15 THEN sqrt(abs(st * (1 - st) / n - vs)) END AS pt, (up + dn - 1) * sqrt(least(nu, n - nu)) AS hm, (sy - ms * my) / CASE WHEN va > 1e-15 THEN sqrt(va) END AS ag FROM b""", "pt hm ag")(
    lambda s, d: tests.directional_statistics(_signed(s, d))
)
query("test_mincer_zarnowitz", X + f""", a AS (SELECT {G}, count(*) AS n, regr_intercept(actual, prediction) AS alpha, regr_slope(actual, prediction) AS beta, regr_sxx(actual, prediction) AS sxx, regr_syy(actual, prediction) AS syy, regr_sxy(actual, prediction) AS sxy, avg(prediction) AS mx FROM fc WHERE {OK} GROUP BY ALL)
SELECT {G}, n, alpha, beta, (n * alpha ^ 2 + 2 * n * mx * alpha * (beta - 1) + (sxx + n * mx ^ 2) * (beta - 1) ^ 2) / ((syy - beta * sxy) / (n - 2)) AS statistic FROM a WHERE n > 2 AND sxx > 0""", "alpha beta statistic")(
    lambda s, d: tests.mincer_zarnowitz_statistics(forecasts(s, d))
)
_XL = lambda k, p: f"CASE WHEN {k} > 0 THEN {k} * ln(CASE WHEN {p} > 0 THEN {p} END) ELSE 0 END"
query("test_interval_coverage", V + f""", m AS (SELECT *, (NOT actual BETWEEN lo AND hi)::INT AS hit FROM v WHERE actual IS NOT NULL AND lo IS NOT NULL), b AS (SELECT *, lag(hit) OVER ({WD}) AS was FROM m),
a AS (SELECT {G}, count(*) AS n, sum(hit)::DOUBLE AS x, count(*) FILTER (was = 0 AND hit = 0)::DOUBLE AS n00, count(*) FILTER (was = 0 AND hit = 1)::DOUBLE AS n01, count(*) FILTER (was = 1 AND hit = 0)::DOUBLE AS n10, count(*) FILTER (was = 1 AND hit = 1)::DOUBLE AS n11 FROM b GROUP BY ALL),
p AS (SELECT *, x / n AS r, coalesce(n01 / nullif(n00 + n01, 0), 0) AS p01, coalesce(n11 / nullif(n10 + n11, 0), 0) AS p11, coalesce((n01 + n11) / nullif(n00 + n01 + n10 + n11, 0), 0) AS pp FROM a),
l AS (SELECT *, -2 * ({_XL("(n - x)", "(0.9::DOUBLE)")} + {_XL("x", "(0.1::DOUBLE)")} - ({_XL("(n - x)", "(1 - r)")}) - ({_XL("x", "r")})) AS uc,
 -2 * ({_XL("(n00 + n10)", "(1 - pp)")} + {_XL("(n01 + n11)", "pp")} - ({_XL("n00", "(1 - p01)")} + {_XL("n01", "p01")} + {_XL("n10", "(1 - p11)")} + {_XL("n11", "p11")})) AS ind FROM p)
SELECT {G}, n, r AS miss_rate, uc AS kupiec, ind AS independence, uc + ind AS conditional FROM l""", "miss_rate kupiec independence conditional")(
    lambda s, d: tests.interval_coverage_statistics(_density(s, d), 0.1)
)
_RS = X + f", e AS (SELECT target, horizon, model, date, {E} AS e FROM fc WHERE {OK}), c AS (SELECT *, e - avg(e) OVER ({WG}) AS c, e - lag(e) OVER ({WD}) AS dd FROM e), q AS (SELECT *, c * c - avg(c * c) OVER ({WG}) AS q FROM c)"
_LB = lambda c, n: "+".join(f"(sum({c}{k}) / nullif(sum({c} * {c}), 0)) ^ 2 / (count(*) - {k})" for k in range(1, n + 1))
query("test_residual_diagnostics", _RS + f""", k AS (SELECT *, {", ".join(f"c * lag(c, {i}) OVER ({WD}) AS c{i}, q * lag(q, {i}) OVER ({WD}) AS q{i}" for i in range(1, 4))} FROM q),
mo AS (SELECT {G}, avg(c ^ 3) / avg(c ^ 2) ^ 1.5 AS sk, avg(c ^ 4) / avg(c ^ 2) ^ 2 - 3 AS ku, count(*) AS n FROM c GROUP BY ALL)
SELECT k.target, k.horizon, k.model, count(*) AS n, count(*) * (count(*) + 2) * ({_LB("c", 3)}) AS ljung_box, count(*) * (count(*) + 2) * ({_LB("q", 3)}) AS mcleod_li,
  max(mo.n / 6 * (sk ^ 2 + ku ^ 2 / 4)) AS jarque_bera, sum(dd * dd) / sum(e * e) AS durbin_watson, exp(-max(mo.n / 6 * (sk ^ 2 + ku ^ 2 / 4)) / 2) AS jarque_bera_p
FROM k JOIN mo USING (target, horizon, model) GROUP BY 1, 2, 3""", "ljung_box mcleod_li jarque_bera durbin_watson jarque_bera_p")(
    lambda s, d: tests.residual_statistics(forecasts(s, d).withColumn("e", F.col("actual") - F.col("prediction")).where("e IS NOT NULL"), "e", ("target", "horizon", "model"), 3)
)
query("test_fluctuation", D + f", m AS (SELECT *, CASE WHEN count(d) OVER w = 12 THEN avg(d) OVER w END AS m FROM d WINDOW w AS ({WD} ROWS 11 PRECEDING)) SELECT {G}, count(d) AS n, sqrt(12) * max(abs(m)) / sqrt(CASE WHEN sum(d * d) > 0 THEN sum(d * d) / (count(d) - 1) END) AS statistic FROM m GROUP BY ALL", "statistic")(
    lambda s, d: tests.fluctuation_statistics(forecasts(s, d), "naive", 12)
)
_PV = D + _hac("d", "acf") + f", p0 AS (SELECT {G}, exp(-((mean / sqrt(lrv / n)) ^ 2) / 2) AS p_value FROM h WHERE lrv > 0), p AS (SELECT *, row_number() OVER (ORDER BY p_value) AS i, count(*) OVER () AS n FROM p0)"


def _pvalues(s, d):
    """exp(-z²/2), which is a chi-square p-value with two degrees: a closed form both engines have."""
    g = tests.hac_mean(tests.loss_differences(forecasts(s, d), "naive"), "d", tests.KEYS, F.col("horizon") - 1)
    z2 = F.pow(F.col("mean") / F.sqrt(F.col("lrv") / F.col("n")), 2)
    return g.where("lrv > 0").select("target", "horizon", "model", F.exp(-z2 / 2).alias("p_value"))


for _m, _e in {
    "bonferroni": "n * p_value", "holm": "max((n - i + 1) * p_value) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING)",
    "bh": "min(n / i * p_value) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)",
}.items():
    query(f"adjust_pvalues_{_m}", _PV + f" SELECT {G}, p_value, least({_e}, 1) AS p_adjusted FROM p", "p_value p_adjusted")(lambda s, d, m=_m: tests.adjust_pvalues(_pvalues(s, d), m))


def _pit(s, d):
    """A rank-based probability transform of the actual among the past ones."""
    w = Window.partitionBy("target", "horizon", "model").orderBy("actual")
    return forecasts(s, d).withColumn("pit", F.percent_rank().over(w))


query("test_pit_histogram", X + f", p AS (SELECT *, least(floor(percent_rank() OVER ({WG} ORDER BY actual) * 10), 9) AS bin FROM fc), t AS (SELECT {G}, count(*) AS total FROM fc GROUP BY ALL) SELECT t.target, t.horizon, t.model, CAST(b AS INT) AS bin, count(p.bin) AS n, total / 10 AS expected FROM t CROSS JOIN range(10) r(b) LEFT JOIN p ON p.target = t.target AND p.horizon = t.horizon AND p.model = t.model AND p.bin = b GROUP BY t.target, t.horizon, t.model, b, total", "expected")(
    lambda s, d: tests.pit_histogram(_pit(s, d), by=("target", "horizon", "model"))
)
query("test_model_confidence_set")(lambda s, d: tests.model_confidence_set(forecasts(s, d), n_boot=199))
query("test_spa_reality_check")(lambda s, d: tests.superior_predictive_ability_test(forecasts(s, d), "naive", n_boot=199))
query("test_stepm")(lambda s, d: tests.stepm_test(forecasts(s, d), "naive", n_boot=199))

# Forecast diagnostics.
query("diagnostic_forecast_overview", X + "SELECT count(*) AS n_rows, count(DISTINCT target) AS n_targets, count(DISTINCT horizon) AS n_horizons, count(DISTINCT model) AS n_models, count(DISTINCT origin) AS n_origins, min(date) AS start, max(date) AS end, count(*) - count(actual) AS n_missing_actual FROM fc")(
    lambda s, d: diagnostics.forecast_overview(forecasts(s, d))
)
query("diagnostic_rolling_loss", X + f"SELECT *, CASE WHEN count{E} OVER w >= 12 THEN sqrt(avg({E} ^ 2) OVER w) END AS rolling_loss FROM fc WINDOW w AS ({WD} ROWS 11 PRECEDING)", "prediction actual rolling_loss")(
    lambda s, d: diagnostics.rolling_loss(forecasts(s, d))
)
query("diagnostic_select_origins", X + f"SELECT * FROM fc QUALIFY (origin_pos - min(origin_pos) OVER ({WG})) % 12 = 0 OR origin_pos = max(origin_pos) OVER ({WG})", "prediction actual")(
    lambda s, d: diagnostics.select_forecast_origins(forecasts(s, d), "every_n")
)
query("diagnostic_first_vs_last", X + f"SELECT {G}, min_by(prediction, origin_pos) AS first, max_by(prediction, origin_pos) AS last, max_by(prediction, origin_pos) - min_by(prediction, origin_pos) AS change FROM fc WHERE model IN ('naive', 'hist_mean') GROUP BY ALL", "first last change")(
    lambda s, d: diagnostics.first_vs_last_forecast(forecasts(s, d).where("model IN ('naive', 'hist_mean')"))
)
query("diagnostic_residual_report", _RS + f", l AS (SELECT *, lag(c) OVER ({WD}) AS b FROM c) SELECT {G}, avg(e) AS mean, stddev_samp(e) AS sd, avg(c ^ 3) / avg(c ^ 2) ^ 1.5 AS skew, count(*) AS n, sum(c * b) / nullif(sum(c * c), 0) AS acf1 FROM l GROUP BY ALL", "mean sd skew acf1")(
    lambda s, d: diagnostics.residual_report(forecasts(s, d))
)
query("diagnostic_residual_autocorrelation", _RS + " " + " UNION ALL ".join(f"SELECT {G}, count(*) AS n, {k} AS lag, sum(c * b) / nullif(sum(c * c), 0) AS acf FROM (SELECT *, lag(c, {k}) OVER ({WD}) AS b FROM c) GROUP BY ALL" for k in (1, 2)), "acf")(
    lambda s, d: diagnostics.residual_autocorrelation(forecasts(s, d), 2)
)
query("diagnostic_residual_qq")(lambda s, d: diagnostics.residual_qq(forecasts(s, d), 11))
query("diagnostic_cumulative_loss", B + f" SELECT {G}, date, sum((actual - bench) ^ 2 - {E} ^ 2) OVER ({WD} ROWS UNBOUNDED PRECEDING) AS cumulative FROM j WHERE model <> 'naive'", "cumulative")(
    lambda s, d: diagnostics.cumulative_loss_differential(forecasts(s, d), "naive")
)
_EW = _H + f", w AS (SELECT *, CASE WHEN min((hs IS NOT NULL)::INT) OVER (PARTITION BY {_AT}) = 1 THEN 1 / greatest(hs, 1e-12) ELSE 1 END AS w FROM hp), ww AS (SELECT {_AT}, model, w / sum(w) OVER (PARTITION BY {_AT}) AS weight FROM w)"
query("diagnostic_ensemble_weights", _EW + " SELECT * FROM ww", "weight")(lambda s, d: diagnostics.ensemble_weights_over_time(forecasts(s, d)))
query("diagnostic_weight_concentration", _EW + f" SELECT {_AT}, sum(weight ^ 2) AS hhi, sum(CASE WHEN weight > 0 THEN -weight * ln(weight) END) AS entropy, 1 / sum(weight ^ 2) AS effective_n FROM ww GROUP BY ALL", "hhi entropy effective_n")(
    lambda s, d: diagnostics.ensemble_weight_concentration(diagnostics.ensemble_weights_over_time(forecasts(s, d)))
)
query("diagnostic_member_contribution", _EW + " SELECT target, horizon, date, model, weight, prediction, weight * prediction AS contribution FROM ww JOIN (SELECT target, horizon, date, model, prediction FROM fc) USING (target, horizon, date, model)", "weight prediction contribution")(
    lambda s, d: diagnostics.ensemble_member_contribution(diagnostics.ensemble_weights_over_time(forecasts(s, d)), forecasts(s, d))
)
query("diagnostic_parameter_stability", _EW + ", o AS (SELECT target, horizon, model, date, weight - 1 / 6 AS value, row_number() OVER (PARTITION BY target, horizon, model ORDER BY date) AS i FROM ww), q AS (SELECT *, lag(sign(value)) OVER (PARTITION BY target, horizon, model ORDER BY i) AS b FROM o) SELECT target, horizon, model, avg(value) AS mean, stddev_samp(value) AS sd, count(*) FILTER (b * sign(value) < 0) AS sign_changes, count(*) AS n, max_by(value, i) - min_by(value, i) AS drift FROM q GROUP BY 1, 2, 3", "mean sd drift")(
    lambda s, d: diagnostics.parameter_stability(
        diagnostics.ensemble_weights_over_time(forecasts(s, d)).withColumn("value", F.col("weight") - 1 / 6)
        .withColumn("origin_pos", F.row_number().over(Window.partitionBy("target", "horizon", "model").orderBy("date"))),
        ("target", "horizon", "model"),
    )
)
