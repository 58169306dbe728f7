"""Panels, cleaning, features, windows and data analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analysis, clean, diagnostics, features, panel, windows
from .bases import ORDER_LONG_SQL, ORDER_SQL, P, SHIP_SQL, order_long, order_panel, ship_panel
from .registry import query

BY = ("series",)
W = "PARTITION BY series ORDER BY date"
S = f"WITH {SHIP_SQL} SELECT series, date, "
O = f"WITH {ORDER_SQL} "  # noqa: E741
L = f"WITH {ORDER_LONG_SQL} "


def _ship(f, keep=("series", "date")):
    """A query that shows the keys and what ``f`` adds to the supplier panel."""

    def run(spark, sf_dir):
        base = ship_panel(spark, sf_dir)
        out = f(base)
        return out.select(*keep, *[c for c in out.columns if c not in base.columns])

    return run


query("panel_order_wide", O + "SELECT * FROM wide", " ".join(P))(order_panel)
query("panel_ship_long", S + "value FROM panel", "value")(ship_panel)

query("features_lag", S + f"lag(value, 1) OVER ({W}) AS value_lag1, lag(value, 3) OVER ({W}) AS value_lag3 FROM panel", "value_lag1 value_lag3")(
    _ship(lambda d: features.lag(d, ["value"], (1, 3), BY))
)
query("features_seasonal_lag", S + f"lag(value, 12) OVER ({W}) AS value_slag1, lag(value, 24) OVER ({W}) AS value_slag2 FROM panel", "value_slag1 value_slag2")(
    _ship(lambda d: features.seasonal_lag(d, ["value"], 12, (1, 2), BY))
)


def _full(n, shift=0, least=None):
    w = f"({W} ROWS BETWEEN {n - 1 + shift} PRECEDING AND {shift} PRECEDING)"
    return f"CASE WHEN count(value) OVER {w} >= {least or n} THEN avg(value) OVER {w} END"


query("features_rolling_mean", S + f"{_full(3)} AS value_mean3, {_full(6)} AS value_mean6 FROM panel", "value_mean3 value_mean6")(
    _ship(lambda d: features.rolling_mean(d, ["value"], (3, 6), by=BY))
)
query("features_rolling_mean_min_periods", S + f"{_full(6, 1, 3)} AS value_mean6 FROM panel", "value_mean6")(
    _ship(lambda d: features.rolling_mean(d, ["value"], (6,), 3, 1, BY))
)
query("features_moving_average_ladder", S + ", ".join(f"{_full(n)} AS value_mean{n}" for n in range(1, 7)) + " FROM panel", " ".join(f"value_mean{n}" for n in range(1, 7)))(
    _ship(lambda d: features.moving_average_ladder(d, ["value"], 6, BY))
)
query("features_marx", S + ", ".join(f"{_full(n, 1)} AS value_marx{n}" for n in range(1, 7)) + " FROM panel", " ".join(f"value_marx{n}" for n in range(1, 7)))(
    _ship(lambda d: features.marx(d, ["value"], 6, BY))
)
_LN = "CASE WHEN {0} > 0 THEN ln(CASE WHEN {0} > 0 THEN {0} END) END"
for _t, _e in {
    "log": _LN.format("value"),
    "diff": f"value - lag(value) OVER ({W})",
    "log_diff": f"{_LN.format('value')} - " + _LN.format("b"),
    "pct_change": "value / nullif(b, 0) - 1",
    "cumsum": f"CASE WHEN value IS NOT NULL THEN sum(value) OVER ({W} ROWS UNBOUNDED PRECEDING) END",
}.items():
    query(f"features_{_t}", f"WITH {SHIP_SQL} SELECT series, date, {_e} AS value_{_t} FROM (SELECT *, lag(value) OVER ({W}) AS b FROM panel)", f"value_{_t}")(
        _ship(lambda d, t=_t: features.transform_features(d, t, ["value"], by=BY))
    )
query("features_moving_average_changes", S + f"CASE WHEN count(value) OVER w = 3 THEN (1 + lag(value, 2) OVER ({W}) / 100) * (1 + lag(value) OVER ({W}) / 100) * (1 + value / 100) * 100 - 100 END AS value_change3 FROM panel WINDOW w AS ({W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)", "value_change3")(
    _ship(lambda d: features.moving_average_changes(d, ["value"], 3, by=BY))
)
query("features_rank_space", O + "SELECT date, " + ", ".join(f"list_sort([p1, p2, p3, p4, p5])[{i}] AS rank_{i}" for i in range(1, 6)) + " FROM wide WHERE p1 + p2 + p3 + p4 + p5 IS NOT NULL", " ".join(f"rank_{i}" for i in range(1, 6)))(
    lambda s, d: features.rank_space_features(order_panel(s, d), P).select("date", *[f"rank_{i}" for i in range(1, 6)]).where("rank_1 IS NOT NULL")
)
query("features_weighted_aggregate", O + "SELECT date, p1 * 0.5 + p2 * 0.25 + p3 * 0.25 + p4 * 0 + p5 * 0 AS weighted FROM wide", "weighted")(
    lambda s, d: features.weighted_aggregate(order_panel(s, d), {"p1": 2, "p2": 1, "p3": 1}, P).select("date", "weighted")
)
query("features_fourier", S + ", ".join(f"{f}(2 * pi() * {k} * (row_number() OVER ({W}) - 1) / 12) AS fourier_{f}{k}" for k in (1, 2) for f in ("sin", "cos")) + " FROM panel", "fourier_sin1 fourier_cos1 fourier_sin2 fourier_cos2")(
    _ship(lambda d: features.fourier_features(d, 12, 2, by=BY))
)
query("features_season_dummy", S + ", ".join(f"(quarter(date) = {q})::INT AS quarter_{q}" for q in range(1, 5)) + " FROM panel")(
    _ship(lambda d: features.season_dummy(d, "quarter"))
)
query("features_time", S + f"CAST(row_number() OVER ({W}) AS INT) AS trend, CAST(month(date) AS INT) AS month, CAST(quarter(date) AS INT) AS quarter, CAST(year(date) AS INT) AS year FROM panel")(
    _ship(lambda d: features.time_features(d, True, True, True, True, BY))
)
query("features_polynomial", O + "SELECT date, p1 * p1 AS p1_x_p1, p1 * p2 AS p1_x_p2, p2 * p2 AS p2_x_p2 FROM wide", "p1_x_p1 p1_x_p2 p2_x_p2")(
    lambda s, d: features.polynomial_features(order_panel(s, d), ["p1", "p2"]).select("date", "p1_x_p1", "p1_x_p2", "p2_x_p2")
)
query("features_interaction", O + "SELECT date, p1 * p2 AS p1_x_p2, p1 * p3 AS p1_x_p3, p2 * p3 AS p2_x_p3 FROM wide", "p1_x_p2 p1_x_p3 p2_x_p3")(
    lambda s, d: features.interaction_features(order_panel(s, d), ["p1", "p2", "p3"]).select("date", "p1_x_p2", "p1_x_p3", "p2_x_p3")
)
query("features_scale_expanding", S + f"(value - avg(value) OVER u) / nullif(stddev_pop(value) OVER u, 0) AS value_scaled FROM panel WINDOW u AS ({W} ROWS UNBOUNDED PRECEDING)", "value_scaled")(
    _ship(lambda d: features.scale_features(d, ["value"], by=BY))
)
query("features_scale_full_minmax", S + "(value - min(value) OVER u) / nullif(max(value) OVER u - min(value) OVER u, 0) AS value_scaled FROM panel WINDOW u AS (PARTITION BY series)", "value_scaled")(
    _ship(lambda d: features.scale_features(d, ["value"], "minmax", "full", BY))
)
query("features_wavelet", S + ", ".join(f"avg(value) OVER w{j} AS value_wA{j}, value - avg(value) OVER w{j} AS value_wD{j}" for j in (1, 2)) + f" FROM panel WINDOW w1 AS ({W} ROWS 1 PRECEDING), w2 AS ({W} ROWS 3 PRECEDING)", "value_wA1 value_wD1 value_wA2 value_wD2")(
    _ship(lambda d: features.wavelet_features(d, ["value"], 2, BY))
)
_SG = "(-3 * {0}(value, 2) OVER w2 + 12 * {0}(value, 1) OVER w2 + 17 * value + 12 * {1}(value, 1) OVER w2 - 3 * {1}(value, 2) OVER w2) / 35"
query("features_savitzky_golay", L + "SELECT series, date, value_sg FROM (SELECT series, date, row_number() OVER w2 AS i, count(*) OVER (PARTITION BY series) AS n, " + _SG.format("lag", "lead") + f" AS value_sg FROM olong WINDOW w2 AS ({W})) WHERE i > 2 AND i <= n - 2", "value_sg")(
    lambda s, d: features.savitzky_golay_features(order_long(s, d), ["value"], by=BY)
    .withColumns({"i": F.row_number().over(features.ordered(BY)), "n": F.count(F.lit(1)).over(features.whole(BY))})
    .where("i > 2 AND i <= n - 2").select("series", "date", "value_sg")
)
query("features_random_projection")(lambda s, d: features.random_projection_features(order_panel(s, d), P).select("date", "rp1", "rp2"))
query("features_mixed_frequency_lags", L + ", q AS (SELECT date_trunc('quarter', date) AS q, avg(value) AS v FROM olong WHERE series = 'p1' GROUP BY 1) SELECT w.date, a.v AS value_l0, b.v AS value_l1 FROM wide w LEFT JOIN q a ON a.q = date_trunc('quarter', w.date) LEFT JOIN q b ON b.q = date_trunc('quarter', w.date) - INTERVAL 3 MONTH", "value_l0 value_l1")(
    lambda s, d: features.mixed_frequency_lags(
        panel.to_lower_frequency(order_long(s, d).where("series = 'p1'").select("date", "value"), "quarter"), order_panel(s, d).select("date"), ["value"]
    )
)
for _t, _e in {
    "level": f"lead(value, 3) OVER ({W})", "change": f"lead(value, 3) OVER ({W}) - value", "growth": f"lead(value, 3) OVER ({W}) / nullif(value, 0) - 1",
    "average_change": f"(lead(value, 3) OVER ({W}) - lead(value, 2) OVER ({W}) + lead(value, 2) OVER ({W}) - lead(value, 1) OVER ({W}) + lead(value, 1) OVER ({W}) - value) / 3",
}.items():
    query(f"target_direct_{_t}", S + f"{_e} AS value_{_t}_h3 FROM panel", f"value_{_t}_h3")(_ship(lambda d, t=_t: features.direct_target(d, "value", (3,), t, BY)))
query("target_forward_average", S + f"CASE WHEN count(value) OVER w = 3 THEN avg(value) OVER w END AS value_fwd3 FROM panel WINDOW w AS ({W} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)", "value_fwd3")(
    _ship(lambda d: features.forward_average_target(d, "value", (3,), BY))
)
query("target_path", S + ", ".join(f"lead(value, {s}) OVER ({W}) - lead(value, {s - 1}) OVER ({W}) AS value_step{s}" for s in (1, 2, 3)) + " FROM panel", "value_step1 value_step2 value_step3")(
    _ship(lambda d: features.path_targets(d, "value", 3, by=BY))
)
query("selection_variance", L + "SELECT series AS feature, var_samp(value) AS score FROM olong GROUP BY 1 ORDER BY 2 DESC LIMIT 2", "score")(
    lambda s, d: features.variance_selection(order_panel(s, d), P, 2)
)
query("selection_correlation", L + "SELECT feature, score FROM (SELECT o.series AS feature, abs(corr(o.value, w.p1)) AS score FROM olong o JOIN wide w USING (date) WHERE o.series <> 'p1' AND p1 + p2 + p3 + p4 + p5 IS NOT NULL GROUP BY 1) ORDER BY score DESC LIMIT 2", "score")(
    lambda s, d: features.correlation_selection(order_panel(s, d), "p1", P, 2)
)
_T = "regr_slope(w.p1, o.value) AS b, regr_sxx(w.p1, o.value) AS sxx, regr_syy(w.p1, o.value) AS syy, regr_sxy(w.p1, o.value) AS sxy, count(*) AS n"
query("selection_marginal_t", L + f"SELECT feature, b / sqrt((syy - b * sxy) / (n - 2) / sxx) AS t_stat FROM (SELECT o.series AS feature, {_T} FROM olong o JOIN wide w USING (date) WHERE o.series <> 'p1' AND o.value IS NOT NULL AND w.p1 IS NOT NULL GROUP BY 1)", "t_stat")(
    lambda s, d: features.marginal_t_stats(order_panel(s, d), "p1", P)
)

# Cleaning.
_Q = "quantile_cont(value, {}) OVER (PARTITION BY series)"
_FAR = f"({_Q.format(.75)} - {_Q.format(.25)}) > 0 AND abs(value - {_Q.format(.5)}) > 1.5 * ({_Q.format(.75)} - {_Q.format(.25)})"
for _a, _e in {
    "flag_as_nan": f"CASE WHEN NOT coalesce({_FAR}, false) THEN value END",
    "replace_with_median": f"CASE WHEN coalesce({_FAR}, false) THEN {_Q.format(.5)} ELSE value END",
    "replace_with_cap_value": f"CASE WHEN coalesce({_FAR}, false) THEN least(greatest(value, {_Q.format(.01)}), {_Q.format(.99)}) ELSE value END",
}.items():
    query(f"clean_iqr_{_a}", S + f"{_e} AS value FROM panel", "value")(lambda s, d, a=_a: clean.iqr_outlier_clean(ship_panel(s, d), ["value"], 1.5, a, BY))
query("clean_zscore", S + "CASE WHEN NOT coalesce(stddev_pop(value) OVER p > 0 AND abs(value - avg(value) OVER p) > 2 * stddev_pop(value) OVER p, false) THEN value END AS value FROM panel WINDOW p AS (PARTITION BY series)", "value")(
    lambda s, d: clean.zscore_outlier_clean(ship_panel(s, d), ["value"], 2.0, by=BY)
)
query("clean_winsorize", S + f"CASE WHEN value IS NOT NULL THEN least(greatest(value, {_Q.format(.05)}), {_Q.format(.95)}) END AS value FROM panel", "value")(
    lambda s, d: clean.winsorize_clean(ship_panel(s, d), ["value"], 0.05, 0.95, BY)
)
query("impute_mean", S + "coalesce(value, avg(value) OVER (PARTITION BY series)) AS value FROM panel", "value")(lambda s, d: clean.mean_impute_clean(ship_panel(s, d), ["value"], BY))
query("impute_forward_fill", S + f"last_value(value IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS value FROM panel", "value")(
    lambda s, d: clean.forward_fill_clean(ship_panel(s, d), ["value"], BY)
)
_I = f"""WITH {SHIP_SQL}, n AS (SELECT *, row_number() OVER ({W}) AS i FROM panel), k AS (
  SELECT series, date, value, i, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER b AS i0, first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER a AS i1,
    last_value(value IGNORE NULLS) OVER b AS v0, first_value(value IGNORE NULLS) OVER a AS v1
  FROM n WINDOW b AS ({W} ROWS UNBOUNDED PRECEDING), a AS ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT series, date, coalesce(value, v0 + (v1 - v0) * (i - i0) / nullif(i1 - i0, 0)) AS value FROM k"""
query("impute_linear", _I, "value")(lambda s, d: clean.linear_interpolate_clean(ship_panel(s, d), ["value"], BY))
query("edges_balanced_rows", S + "value FROM panel WHERE value IS NOT NULL", "value")(lambda s, d: clean.truncate_to_balanced_clean(ship_panel(s, d), ["value"], BY))
query("edges_balanced_series", L + "SELECT series, date, value FROM olong QUALIFY count(*) OVER (PARTITION BY series) = count(value) OVER (PARTITION BY series)", "value")(
    lambda s, d: clean.drop_unbalanced_keys(order_long(s, d), ["value"], BY).select("series", "date", "value")
)
query("edges_zero_fill", S + "coalesce(value, 0) AS value FROM panel", "value")(lambda s, d: clean.zero_fill_leading_clean(ship_panel(s, d), ["value"], BY))
for _m, _c, _s in (
    ("zscore", "avg(value) OVER p", "stddev_pop(value) OVER p"), ("robust", "median(value) OVER p", f"({_Q.format(.75)} - {_Q.format(.25)})"),
    ("minmax", "min(value) OVER p", "(max(value) OVER p - min(value) OVER p)"),
):
    query(f"standardize_{_m}", L + f"SELECT series, date, (value - {_c}) / {_s} AS value FROM olong WINDOW p AS (PARTITION BY series)", "value")(
        lambda s, d, m=_m: clean.standardize_clean(order_long(s, d), ["value"], m, by=BY).select("series", "date", "value")
    )
query("standardize_fit_scope", L + "SELECT series, date, (value - a) / s AS value FROM olong JOIN (SELECT series, avg(value) AS a, stddev_pop(value) AS s FROM olong WHERE date <= DATE '1998-12-31' GROUP BY 1) USING (series)", "value")(
    lambda s, d: clean.standardize_panel(order_long(s, d), "1998-12-31", ["value"], by=BY).select("series", "date", "value")
)
_SAFE = "CASE WHEN m >= 1e-6 AND {0} > 0 THEN ln(CASE WHEN {0} > 0 THEN {0} END) END"
for _k, _e in {
    1: "value", 2: "value - b", 3: "value - 2 * b + c", 4: _SAFE.format("value"), 5: _SAFE.format("value") + " - " + _SAFE.format("b"),
    6: _SAFE.format("value") + " - 2 * " + _SAFE.format("b") + " + " + _SAFE.format("c"), 7: "(value / nullif(b, 0) - 1) - (b / nullif(c, 0) - 1)",
}.items():
    query(f"tcode_{_k}", f"WITH {SHIP_SQL} SELECT series, date, {_e} AS value FROM (SELECT *, lag(value) OVER ({W}) AS b, lag(value, 2) OVER ({W}) AS c, min(value) OVER (PARTITION BY series) AS m FROM panel)", "value")(
        lambda s, d, k=_k: clean.apply_tcode_transform(ship_panel(s, d), {"value": k}, BY).select("series", "date", "value")
    )
query("reprocess_chain", f"""WITH {ORDER_LONG_SQL}, t AS (SELECT series, date, ln(value) - ln(lag(value) OVER ({W})) AS v, row_number() OVER ({W}) AS i FROM olong),
u AS (SELECT series, date, CASE WHEN NOT coalesce(q3 - q1 > 0 AND abs(v - q2) > 10 * (q3 - q1), false) THEN v END AS v FROM (SELECT *, quantile_cont(v, .25) OVER p AS q1, quantile_cont(v, .5) OVER p AS q2, quantile_cont(v, .75) OVER p AS q3 FROM t WHERE i > 1 WINDOW p AS (PARTITION BY series))),
f AS (SELECT series, date, last_value(v IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS v FROM u)
SELECT series, date, (v - avg(v) OVER p) / stddev_pop(v) OVER p AS value FROM f WINDOW p AS (PARTITION BY series)""", "value")(
    lambda s, d: clean.reprocess(order_long(s, d), {"value": 5}, BY).select("series", "date", "value")
)

# Panel operators.
for _r, _e in {"mean": "avg(value)", "sum": "sum(value)", "last": "max_by(value, date) FILTER (value IS NOT NULL)", "first": "min_by(value, date) FILTER (value IS NOT NULL)"}.items():
    query(f"frequency_quarterly_{_r}", f"WITH {SHIP_SQL} SELECT series, CAST(date_trunc('quarter', date) AS DATE) AS date, {_e} AS value FROM panel GROUP BY 1, 2", "value")(
        lambda s, d, r=_r: panel.to_lower_frequency(ship_panel(s, d), "quarter", r, ["value"], BY)
    )
query("frequency_monthly_step", f"""WITH {ORDER_LONG_SQL}, q AS (SELECT series, CAST(date_trunc('quarter', date) AS DATE) AS date, avg(value) AS v FROM olong GROUP BY 1, 2),
g AS (SELECT series, unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP + INTERVAL 2 MONTH, INTERVAL 1 MONTH))::DATE AS date FROM q GROUP BY 1)
SELECT g.series, g.date, last_value(v IGNORE NULLS) OVER (PARTITION BY g.series ORDER BY g.date ROWS UNBOUNDED PRECEDING) AS value FROM g LEFT JOIN q USING (series, date)""", "value")(
    lambda s, d: panel.to_monthly(panel.to_lower_frequency(order_long(s, d), "quarter", "mean", ["value"], BY), "step_forward", ["value"], BY)
)
query("frequency_infer", f"""WITH {SHIP_SQL}, g AS (SELECT series, date_diff('day', lag(date) OVER ({W}), date) AS d FROM panel WHERE value IS NOT NULL), m AS (SELECT series, median(d) AS d FROM g GROUP BY 1)
SELECT series, CASE WHEN d IS NULL THEN 'unknown' WHEN d BETWEEN 5 AND 9 THEN 'weekly' WHEN d BETWEEN 27 AND 32 THEN 'monthly' WHEN d BETWEEN 85 AND 95 THEN 'quarterly' WHEN d BETWEEN 355 AND 375 THEN 'annual' ELSE 'irregular' END AS frequency FROM m""")(
    lambda s, d: panel.infer_frequencies(ship_panel(s, d).withColumnRenamed("series", "key"), ["value"], ("key",)).select(F.col("key").alias("series"), "frequency")
)
query("panel_availability_lag", S + f"lag(value, 2) OVER ({W}) AS value FROM panel", "value")(lambda s, d: panel.availability_lag(ship_panel(s, d), 2, ["value"], BY))
query("panel_same_period_lag", O + "SELECT date, p1, " + ", ".join(f"lag({p}) OVER (ORDER BY date) AS {p}" for p in P[1:]) + " FROM wide", " ".join(P))(
    lambda s, d: panel.same_period_predictors(order_panel(s, d), ["p1"], "lag")
)
query("panel_regime_threshold", O + "SELECT date, (p1 > 5)::INT AS regime FROM wide")(lambda s, d: panel.define_regime(order_panel(s, d), column="p1", threshold=5.0).select("date", "regime"))
query("panel_regime_dates", O + "SELECT date, (date BETWEEN DATE '1996-01-01' AND DATE '1997-06-01')::INT AS regime FROM wide")(
    lambda s, d: panel.define_regime(order_panel(s, d), dates=[("1996-01-01", "1997-06-01")]).select("date", "regime")
)
query("panel_info", O + "SELECT count(*) AS n_rows, 5::BIGINT AS n_series, min(date) AS start, max(date) AS end, (5 * count(*) - count(p1) - count(p2) - count(p3) - count(p4) - count(p5))::BIGINT AS n_missing FROM wide")(
    lambda s, d: panel.panel_info(order_panel(s, d))
)
query("panel_combine", O + f", s AS (WITH {SHIP_SQL} SELECT date, sum(value) AS shipped FROM panel GROUP BY 1) SELECT date, p1, shipped FROM wide FULL JOIN s USING (date)", "p1 shipped")(
    lambda s, d: panel.combine(order_panel(s, d).select("date", "p1"), ship_panel(s, d).groupBy("date").agg(F.sum("value").alias("shipped")))
)
query("vintage_list", "SELECT strftime(unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '1996-12-01', INTERVAL 1 MONTH)), '%Y-%m') AS vintage")(
    lambda s, d: panel.list_vintages(s, "1995-01-15", "1996-12-20")
)


def _vintages(s, d):
    """Each quarter a vintage of what was then known, revised a little every time."""
    long = order_long(s, d)
    v = long.select(F.trunc("date", "quarter").alias("vintage")).distinct()
    revised = F.col("value") * (1 + F.months_between("vintage", "date") / 1000)
    return v.join(long, F.col("date") < F.col("vintage")).select("vintage", "date", "series", revised.alias("value"))


_V = f"WITH {ORDER_LONG_SQL}, vs AS (SELECT DISTINCT CAST(date_trunc('quarter', date) AS DATE) AS vintage FROM olong), v AS (SELECT vintage, date, series, value * (1 + date_diff('month', date, vintage) / 1000) AS value FROM vs JOIN olong ON date < vintage) "
query("vintage_snapshots", _V + ", o AS (SELECT DISTINCT date + INTERVAL 14 DAY AS origin FROM olong), r AS (SELECT origin::DATE AS origin, max(vintage) AS vintage FROM o JOIN (SELECT DISTINCT vintage FROM v) ON vintage <= origin GROUP BY 1) SELECT vintage, origin, date, series, value FROM r JOIN v USING (vintage)", "value")(
    lambda s, d: panel.snapshots(_vintages(s, d), order_panel(s, d).select(F.date_add("date", 14).alias("origin")))
)
for _r, _f in (("latest", "max_by"), ("first_release", "min_by")):
    query(f"vintage_actuals_{_r}", _V + f"SELECT series, date, {_f}(value, vintage) AS value FROM v WHERE value IS NOT NULL GROUP BY 1, 2", "value")(lambda s, d, r=_r: panel.actuals(_vintages(s, d), r))

# Windows.
query("window_origins", "SELECT CAST(o AS INT) AS origin_pos, CAST(greatest(0, o - 24) AS INT) AS fit_start, CAST(o - 1 AS INT) AS fit_end, CAST(o AS INT) AS test_start, CAST(o + 2 AS INT) AS test_end, (o - 24) % 3 = 0 AS retrain, (o - 24) % 6 = 0 AND (o - 24) % 3 = 0 AS retune FROM range(24, 79) t(o) WHERE o + 2 < 79")(
    lambda s, d: windows.origins(s, 79, windows.spec(windows.estimation_rolling(24, min_size=24, retrain_every=3), windows.val_last_block(retune_every=6), windows.test_origins(horizon=3)))
)
query("window_expanding_folds", "SELECT CAST(i - 50 AS INT) AS fold, 0 AS train_start, CAST(i AS INT) AS train_end, CAST(i + 2 AS INT) AS val_start, CAST(i + 5 AS INT) AS val_end FROM range(50, 96) t(i)")(
    lambda s, d: windows.split_table(s, "expanding", 100, horizon=3, embargo=2)
)
query("window_blocked_kfold", "SELECT CAST(k AS INT) - 1 AS fold, 0 AS train_start, CAST(k * 20 - 1 AS INT) AS train_end, CAST(k * 20 AS INT) AS val_start, CAST(k * 20 + 20 AS INT) AS val_end FROM range(1, 5) t(k)")(
    lambda s, d: windows.split_table(s, "blocked_kfold", 100, embargo=1)
)
query("window_stage_panel", O + ", n AS (SELECT date, p1, row_number() OVER (ORDER BY date) - 1 AS pos FROM wide) SELECT o::INT AS origin_pos, count(*) AS n, sum(p1) AS total FROM range(24, 79, 6) t(o) JOIN n ON pos BETWEEN o - 24 AND o - 1 GROUP BY 1", "total")(
    lambda s, d: windows.stage_panel(order_panel(s, d), windows.origins(s, 79, windows.spec(windows.estimation_rolling(24, min_size=24), None, windows.test_origins(step=6))), windows.stage_policy("fit_window"))
    .groupBy("origin_pos").agg(F.count(F.lit(1)).alias("n"), F.sum("p1").alias("total"))
)

# Data analysis.
query("analysis_univariate_summary", f"WITH {SHIP_SQL} SELECT series, avg(value) AS mean, stddev_samp(value) AS sd, min(value) AS min, max(value) AS max, skewness(value) AS skew, kurtosis(value) AS kurtosis, count(value) AS n, count(*) - count(value) AS n_missing FROM panel GROUP BY 1", "mean sd min max skew kurtosis")(
    lambda s, d: analysis.univariate_summary(ship_panel(s, d))
)
query("analysis_sample_coverage", f"WITH {SHIP_SQL} SELECT series, min(date) FILTER (value IS NOT NULL) AS start, max(date) FILTER (value IS NOT NULL) AS end, count(value) AS n, count(*) - count(value) AS n_missing FROM panel GROUP BY 1")(
    lambda s, d: analysis.sample_coverage(ship_panel(s, d))
)
query("analysis_missing_summary", f"""WITH {SHIP_SQL}, i AS (SELECT series, value, row_number() OVER ({W}) - sum((value IS NULL)::INT) OVER ({W} ROWS UNBOUNDED PRECEDING) AS g FROM panel),
r AS (SELECT series, g, count(*) - count(value) AS m, count(*) AS n FROM i GROUP BY 1, 2) SELECT series, sum(m)::BIGINT AS n_missing, sum(m) / sum(n) AS missing_rate, max(m)::BIGINT AS longest_gap FROM r GROUP BY 1""", "missing_rate")(
    lambda s, d: analysis.missing_summary(ship_panel(s, d))
)
query("analysis_outlier_summary", f"""WITH {SHIP_SQL}, q AS (SELECT series, quantile_cont(value, .25) AS a, median(value) AS b, quantile_cont(value, .75) AS c, avg(value) AS m, stddev_pop(value) AS s FROM panel GROUP BY 1)
SELECT series, count(*) FILTER (c - a > 0 AND abs(value - b) > 1.5 * (c - a)) AS iqr_outliers, count(*) FILTER (s > 0 AND abs(value - m) > 2 * s) AS zscore_outliers FROM panel JOIN q USING (series) GROUP BY 1""")(
    lambda s, d: analysis.outlier_summary(ship_panel(s, d), iqr_threshold=1.5, zscore_threshold=2.0)
)
query("analysis_correlation_pearson", L + "SELECT x.series AS a, y.series AS b, corr(x.value, y.value) AS corr, count(*) AS n FROM olong x JOIN olong y USING (date) WHERE x.series < y.series AND x.value IS NOT NULL AND y.value IS NOT NULL GROUP BY 1, 2", "corr")(
    lambda s, d: analysis.correlation_pairs(order_long(s, d))
)
query("analysis_correlation_spearman", L + ", j AS (SELECT x.series AS a, y.series AS b, x.value AS u, y.value AS v FROM olong x JOIN olong y USING (date) WHERE x.series < y.series AND x.value IS NOT NULL AND y.value IS NOT NULL), r AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY u) + (count(*) OVER (PARTITION BY a, b, u) - 1) / 2 AS u, rank() OVER (PARTITION BY a, b ORDER BY v) + (count(*) OVER (PARTITION BY a, b, v) - 1) / 2 AS v FROM j) SELECT a, b, corr(u, v) AS corr, count(*) AS n FROM r GROUP BY 1, 2", "corr")(
    lambda s, d: analysis.correlation_pairs(order_long(s, d), "spearman")
)
_CH = f"WITH {SHIP_SQL}, c AS (SELECT series, date, coalesce(value, avg(value) OVER (PARTITION BY series)) AS value FROM panel) "


def _imputed_cells(s, d):
    """series, date, raw, clean of one computation of the panel."""
    filled = clean.mean_impute_clean(ship_panel(s, d).withColumn("raw", F.col("value")), ["value"], BY)
    return filled.select("series", "date", "raw", F.col("value").alias("clean"))


query("analysis_changed_cells", _CH + "SELECT series, count(*) FILTER (p.value IS DISTINCT FROM c.value) AS n_changed, avg((p.value IS DISTINCT FROM c.value)::INT) AS change_rate FROM panel p JOIN c USING (series, date) GROUP BY 1", "change_rate")(
    lambda s, d: analysis.change_summary(analysis.cell_changes(_imputed_cells(s, d)))
)
query("analysis_distribution_shift", _CH + """, u AS (SELECT series, value, sum(a) AS na, sum(1 - a) AS nb FROM (SELECT series, value, 1 AS a FROM panel WHERE value IS NOT NULL UNION ALL SELECT series, value, 0 FROM c WHERE value IS NOT NULL) GROUP BY 1, 2),
k AS (SELECT series, abs(sum(na) OVER r / sum(na) OVER p - sum(nb) OVER r / sum(nb) OVER p) AS d FROM u WINDOW p AS (PARTITION BY series), r AS (PARTITION BY series ORDER BY value ROWS UNBOUNDED PRECEDING)),
a AS (SELECT series, avg(value) AS m, stddev_samp(value) AS s FROM panel GROUP BY 1), b AS (SELECT series, avg(value) AS m, stddev_samp(value) AS s FROM c GROUP BY 1)
SELECT series, b.m - a.m AS mean_change, b.s / nullif(a.s, 0) AS sd_ratio, ks FROM a JOIN b USING (series) JOIN (SELECT series, max(d) AS ks FROM k GROUP BY 1) USING (series)""", "mean_change sd_ratio ks")(
    lambda s, d: analysis.cell_distribution_shift(_imputed_cells(s, d))
)
_AC = f"WITH {ORDER_LONG_SQL}, e AS (SELECT series, date, value - avg(value) OVER (PARTITION BY series) AS e FROM olong WHERE value IS NOT NULL) "
query("analysis_acf", _AC + ", " + ", ".join(f"l{k} AS (SELECT series, count(*) AS n, {k} AS lag, sum(e * b) / sum(e * e) AS acf FROM (SELECT *, lag(e, {k}) OVER ({W}) AS b FROM e) GROUP BY 1)" for k in (1, 2, 3)) + " SELECT *, 1.959963984540054 / sqrt(n) AS band FROM (" + " UNION ALL ".join(f"FROM l{k}" for k in (1, 2, 3)) + ")", "acf band")(
    lambda s, d: analysis.acf(order_long(s, d), nlags=3)
)
query("analysis_structural_stability", _AC + f"SELECT series, max(abs(c)) / (sqrt(sum(e * e) / (count(*) - 1)) * sqrt(count(*))) AS statistic, count(*) AS n FROM (SELECT *, sum(e) OVER ({W} ROWS UNBOUNDED PRECEDING) AS c FROM e) GROUP BY 1", "statistic")(
    lambda s, d: analysis.structural_stability(order_long(s, d))
)
query("analysis_kpss", _AC + f"SELECT series, sum(c * c) / (count(*) * count(*)) / (sum(e * e) / count(*) + 2 * (1 - 1 / 3) * sum(e * b) / count(*) + 2 * (1 - 2 / 3) * sum(e * d) / count(*)) AS kpss, count(*) AS n FROM (SELECT *, lag(e) OVER ({W}) AS b, lag(e, 2) OVER ({W}) AS d, sum(e) OVER ({W} ROWS UNBOUNDED PRECEDING) AS c FROM e) GROUP BY 1", "kpss")(
    lambda s, d: analysis.kpss_statistic(order_long(s, d), 2)
)
query("analysis_variance_ratio", L + f""", d AS (SELECT series, date, value - lag(value) OVER ({W}) AS d FROM olong WHERE value IS NOT NULL), e AS (SELECT series, date, d - avg(d) OVER (PARTITION BY series) AS e FROM d WHERE d IS NOT NULL),
s AS (SELECT *, e + lag(e) OVER ({W}) AS s, e * lag(e) OVER ({W}) AS p FROM e), g AS (SELECT series, count(*) AS n, sum(e * e) AS den, sum(s * s) AS ss, sum(p * p) AS pp FROM s GROUP BY 1),
v AS (SELECT series, n, ss / (2 * (n - 1) * (1 - 2 / n)) / (den / (n - 1)) AS vr, pp / (den * den) AS theta FROM g) SELECT series, n, vr AS variance_ratio, (vr - 1) / sqrt(theta) AS z FROM v""", "variance_ratio z")(
    lambda s, d: analysis.variance_ratio(order_long(s, d), 2)
)
query("diagnostic_factor_variance", L + "SELECT *, sum(share) OVER (ORDER BY variance DESC ROWS UNBOUNDED PRECEDING) AS cumulative FROM (SELECT series, var_samp(value) AS variance, var_samp(value) / sum(var_samp(value)) OVER () AS share FROM olong GROUP BY 1)", "variance share cumulative")(
    lambda s, d: diagnostics.factor_variance(order_long(s, d))
)
query("diagnostic_feature_overview", f"WITH {SHIP_SQL} SELECT series, count(value) AS n, avg((value IS NULL)::INT) AS missing_rate, var_samp(value) AS variance, avg((value IS NULL)::INT) > 0.5 AS high_missing FROM panel GROUP BY 1", "missing_rate variance")(
    lambda s, d: diagnostics.feature_overview(ship_panel(s, d))
)
query("diagnostic_feature_target_correlation", L + "SELECT o.series, corr(o.value, w.p1) AS corr, count(*) AS n FROM olong o JOIN wide w USING (date) WHERE o.value IS NOT NULL AND p1 IS NOT NULL GROUP BY 1", "corr")(
    lambda s, d: diagnostics.feature_target_correlation(order_long(s, d), order_panel(s, d).select("date", F.col("p1").alias("y")))
)
query("diagnostic_lag_correlation_decay", f"WITH {SHIP_SQL} SELECT series, k AS lag, c AS corr FROM (" + " UNION ALL ".join(f"SELECT series, {k} AS k, corr(value, b) AS c FROM (SELECT *, lag(value, {k}) OVER ({W}) AS b FROM panel) GROUP BY 1" for k in (1, 2, 3)) + ")", "corr")(
    lambda s, d: diagnostics.lag_correlation_decay(ship_panel(s, d), 3)
)
query("diagnostic_marx_weight_decay", "SELECT CAST(o AS INT) AS \"order\", CAST(l AS INT) AS lag, 1.0 / o AS weight FROM range(1, 13) a(o), range(1, 13) b(l) WHERE l <= o", "weight")(
    lambda s, d: diagnostics.marx_weight_decay(s)
)
_SEL = "(SELECT date AS run, series AS feature FROM olong QUALIFY row_number() OVER (PARTITION BY date ORDER BY value DESC, series) <= 2)"


def _selections(s, d):
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy("date").orderBy(F.col("value").desc(), "series"))
    return order_long(s, d).withColumn("r", r).where("r <= 2").select(F.col("date").alias("run"), F.col("series").alias("feature"))


query("diagnostic_selection_stability", L + f"SELECT feature, count(DISTINCT run) AS n, count(DISTINCT run) / (SELECT count(DISTINCT run) FROM {_SEL}) AS frequency FROM {_SEL} GROUP BY 1", "frequency")(
    lambda s, d: diagnostics.selection_stability(_selections(s, d))
)
query("diagnostic_selection_similarity", L + f", g AS (SELECT run, list(feature) AS s FROM {_SEL} GROUP BY 1) SELECT x.run AS a, y.run AS b, len(list_intersect(x.s, y.s)) / len(list_distinct(x.s || y.s)) AS similarity FROM g x JOIN g y ON x.run < y.run", "similarity")(
    lambda s, d: diagnostics.selection_similarity(_selections(s, d))
)
