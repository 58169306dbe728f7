"""Diagnostics of forecasts, features, selections and weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import norm_ppf
from ._base import DATE, ordered, ratio, upto, whole

GROUP = ("target", "horizon", "model")


def forecast_overview(forecasts: DataFrame) -> DataFrame:
    return forecasts.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("target").alias("n_targets"), F.count_distinct("horizon").alias("n_horizons"),
        F.count_distinct("model").alias("n_models"), F.count_distinct("origin").alias("n_origins"), F.min(DATE).alias("start"), F.max(DATE).alias("end"),
        F.count_if(F.col("actual").isNull()).alias("n_missing_actual"),
    )


def fitted_vs_actual(forecasts: DataFrame, drop_missing_actual: bool = True) -> DataFrame:
    out = forecasts.withColumn("residual", F.col("actual") - F.col("prediction"))
    return out.where("actual IS NOT NULL") if drop_missing_actual else out


def residual_report(forecasts: DataFrame, by: Sequence[str] = GROUP) -> DataFrame:
    from .metrics import acf1

    r = fitted_vs_actual(forecasts).where("residual IS NOT NULL")
    g = r.groupBy(*by).agg(F.avg("residual").alias("mean"), F.stddev_samp("residual").alias("sd"), F.skewness("residual").alias("skew"), F.count("residual").alias("n"))
    return g.join(acf1(r, "residual", by), list(by))


def residual_autocorrelation(forecasts: DataFrame, max_lag: int = 12, by: Sequence[str] = GROUP) -> DataFrame:
    from .tests_stat import autocorrelations

    return autocorrelations(fitted_vs_actual(forecasts), "residual", by, max_lag)


def residual_qq(forecasts: DataFrame, n_quantiles: int = 21, by: Sequence[str] = GROUP) -> DataFrame:
    """Residual quantiles against those of a standard normal."""
    q = [(i + 0.5) / n_quantiles for i in range(n_quantiles)]
    r = fitted_vs_actual(forecasts).groupBy(*by).agg(F.percentile("residual", F.array(*[F.lit(x) for x in q])).alias("sample"))
    normal = F.array(*[F.lit(float(norm_ppf(x))) for x in q])
    z = F.arrays_zip(F.array(*[F.lit(x) for x in q]).alias("p"), F.col("sample"), normal.alias("normal"))
    return r.select(*by, F.explode(z).alias("z")).select(*by, F.col("z.p").alias("probability"), F.col("z.sample").alias("sample"), F.col("z.normal").alias("normal"))


def rolling_loss(forecasts: DataFrame, metric: str = "rmse", window: int = 12, min_periods: int | None = None, by: Sequence[str] = GROUP) -> DataFrame:
    e = F.col("actual") - F.col("prediction")
    loss = e * e if metric == "rmse" else F.abs(e)
    w = ordered(by).rowsBetween(-(window - 1), 0)
    rows = forecasts.withColumn("_l", loss)
    value = F.avg("_l").over(w)
    value = F.sqrt(value) if metric == "rmse" else value
    return rows.withColumn("rolling_loss", F.when(F.count("_l").over(w) >= (window if min_periods is None else min_periods), value)).drop("_l")


def select_forecast_origins(forecasts: DataFrame, view: str = "all_origins", every_n: int = 12, include_last: bool = True, by: Sequence[str] = GROUP) -> DataFrame:
    if view == "all_origins":
        return forecasts
    w = whole(by)
    last = F.col("origin_pos") == F.max("origin_pos").over(w)
    if view == "last_origin":
        keep = last
    else:
        keep = (F.col("origin_pos") - F.min("origin_pos").over(w)) % every_n == 0
        keep = keep | last if include_last else keep
    return forecasts.withColumn("_keep", keep).where("_keep").drop("_keep")


def first_vs_last_forecast(forecasts: DataFrame, by: Sequence[str] = GROUP) -> DataFrame:
    return forecasts.groupBy(*by).agg(
        F.min_by("prediction", "origin_pos").alias("first"), F.max_by("prediction", "origin_pos").alias("last"),
    ).withColumn("change", F.col("last") - F.col("first"))


def forecast_scale_view(forecasts: DataFrame, levels: DataFrame, transform: str = "change") -> DataFrame:
    """Predictions of changes, growth or log growth back on the level scale of their origin (target, date, level)."""
    at = levels.select("target", F.col("date").alias("origin"), F.col("level").alias("origin_level"))
    j = forecasts.join(at, ["target", "origin"])
    p, base = F.col("prediction"), F.col("origin_level")
    value = {"level": p, "change": base + p, "growth": base * (1 + p), "log_growth": base * F.exp(p)}[transform]
    return j.withColumn("prediction_level", value)


def cumulative_loss_differential(forecasts: DataFrame, benchmark: str) -> DataFrame:
    """Running sum of benchmark loss less contender loss."""
    from .metrics import compute_point_loss, with_benchmark

    rows = with_benchmark(forecasts, benchmark).where(F.col("model") != benchmark)
    d = compute_point_loss(p="benchmark_prediction") - compute_point_loss()
    return rows.withColumn("_d", d).withColumn("cumulative", F.sum("_d").over(upto(GROUP))).select(*GROUP, "date", "cumulative")


def coefficient_trace(long: DataFrame) -> DataFrame:
    return long.orderBy("model", "coefficient", "origin_pos")


def parameter_stability(trace: DataFrame, by: Sequence[str] = ("model", "coefficient")) -> DataFrame:
    """Mean, deviation, drift from first to last origin and sign changes of a coefficient path (origin_pos, value)."""
    before = F.lag(F.signum("value")).over(ordered(by, "origin_pos"))
    t = trace.withColumn("_flip", ((before * F.signum("value")) < 0).cast("int"))
    g = t.groupBy(*by).agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min_by("value", "origin_pos").alias("_f"),
        F.max_by("value", "origin_pos").alias("_l"), F.coalesce(F.sum("_flip"), F.lit(0)).alias("sign_changes"), F.count("value").alias("n"),
    )
    return g.withColumn("drift", F.col("_l") - F.col("_f")).drop("_f", "_l")


def ensemble_weight_concentration(weights: DataFrame, by: Sequence[str] = ("target", "horizon", "date")) -> DataFrame:
    """hhi, effective_n and entropy of weights (model, weight)."""
    w = F.col("weight")
    g = weights.groupBy(*by).agg(F.sum(w * w).alias("hhi"), F.sum(F.when(w > 0, -w * F.ln(F.when(w > 0, w)))).alias("entropy"))
    return g.withColumn("effective_n", ratio(F.lit(1.0), F.col("hhi")))


def ensemble_member_contribution(weights: DataFrame, forecasts: DataFrame) -> DataFrame:
    keys = ["target", "horizon", "date", "model"]
    return weights.join(forecasts.select(*keys, "prediction"), keys).withColumn("contribution", F.col("weight") * F.col("prediction"))


def ensemble_weights_over_time(forecasts: DataFrame, horizon_rows: int = 1) -> DataFrame:
    """Normalised inverse-MSPE weights as the combination uses them."""
    from .combine import AT, _lagged_loss

    rows = _lagged_loss(forecasts, F.sum, horizon_rows).where("prediction IS NOT NULL")
    at = Window.partitionBy(*AT)
    raw = F.when(F.min(F.col("_h").isNotNull()).over(at), 1 / F.greatest("_h", F.lit(1e-12))).otherwise(1.0)
    return rows.withColumn("_w", raw).withColumn("weight", F.col("_w") / F.sum("_w").over(at)).select(*AT, "model", "weight")


def hyperparameter_path(selection: DataFrame) -> DataFrame:
    """One row per parameter of a ``params`` map."""
    return selection.select(*[c for c in selection.columns if c != "params"], F.explode("params").alias("parameter", "value"))


def tuning_score_distribution(trials: DataFrame, by: Sequence[str] = ("model", "horizon", "method")) -> DataFrame:
    return trials.groupBy(*by).agg(F.count("score").alias("n"), F.min("score").alias("min"), F.median("score").alias("median"), F.max("score").alias("max"))


# Features and selections.


def feature_overview(long: DataFrame, high_missing_threshold: float = 0.5) -> DataFrame:
    rate = F.avg(F.col("value").isNull().cast("double"))
    return long.groupBy("series").agg(F.count("value").alias("n"), rate.alias("missing_rate"), F.var_samp("value").alias("variance"), (rate > high_missing_threshold).alias("high_missing"))


def feature_correlation(long: DataFrame, threshold: float = 0.9, method: str = "pearson", min_periods: int = 3) -> DataFrame:
    """Pairs at or above the threshold in absolute value."""
    from .analysis import correlation_pairs

    return correlation_pairs(long, method, min_periods).where(F.abs("corr") >= threshold)


def feature_target_correlation(long: DataFrame, target: DataFrame, absolute: bool = True) -> DataFrame:
    """series, corr with target (date, y)."""
    g = long.join(target, "date").where("value IS NOT NULL AND y IS NOT NULL").groupBy("series").agg(F.corr("value", "y").alias("corr"), F.count(F.lit(1)).alias("n"))
    return g


def factor_variance(factors: DataFrame) -> DataFrame:
    """Variance share of each factor series and the running sum, largest first."""
    g = factors.groupBy("series").agg(F.var_samp("value").alias("variance"))
    share = F.col("variance") / F.sum("variance").over(Window.partitionBy())  # one row per factor
    w = Window.partitionBy().orderBy(F.col("variance").desc(), "series").rowsBetween(Window.unboundedPreceding, 0)
    return g.withColumn("share", share).withColumn("cumulative", F.sum("share").over(w))


def lag_correlation_decay(long: DataFrame, max_lag: int = 12, by: Sequence[str] = ("series",)) -> DataFrame:
    """Correlation of each series with its own lags."""
    w = ordered(by)
    lags = long.withColumns({f"_l{k}": F.lag("value", k).over(w) for k in range(1, max_lag + 1)})
    g = lags.groupBy(*by).agg(*[F.corr("value", f"_l{k}").alias(str(k)) for k in range(1, max_lag + 1)])
    return g.unpivot(list(by), [str(k) for k in range(1, max_lag + 1)], "lag", "corr").withColumn("lag", F.col("lag").cast("int"))


def marx_weight_decay(spark, max_lag: int = 12) -> DataFrame:
    """Weight of each lag in each of the means 1..max_lag."""
    w = spark.range(1, max_lag + 1).select(F.col("id").cast("int").alias("order"))
    return w.select("order", F.explode(F.sequence(F.lit(1), F.col("order"))).alias("lag")).withColumn("weight", 1 / F.col("order"))


def selection_stability(selections: DataFrame) -> DataFrame:
    """feature, frequency over the runs of (run, feature)."""
    total = selections.agg(F.count_distinct("run").alias("runs")).scalar()
    return selections.groupBy("feature").agg(F.count_distinct("run").alias("n")).withColumn("frequency", F.col("n") / total)


def selection_similarity(selections: DataFrame, metric: str = "jaccard", n_features: int | None = None) -> DataFrame:
    """Jaccard or Kuncheva similarity of all pairs of runs."""
    sets = selections.groupBy("run").agg(F.collect_set("feature").alias("s"))
    a, b = sets.select(F.col("run").alias("a"), F.col("s").alias("x")), sets.select(F.col("run").alias("b"), F.col("s").alias("y"))
    j = a.join(b, F.col("a") < F.col("b"))  # runs, not rows: a small dimension
    both = F.size(F.array_intersect("x", "y"))
    if metric == "jaccard":
        value = ratio(both.cast("double"), F.size(F.array_union("x", "y")))
    else:
        k = F.greatest(F.size("x"), F.size("y"))
        value = ratio(both * n_features - k * k, (k * (n_features - k)).cast("double"))
    return j.select("a", "b", value.alias("similarity"))


def selection_frequency_table(history: DataFrame, by: Sequence[str] = ("arm", "horizon", "kind", "name")) -> DataFrame:
    """Origins that select a name over the origins of its group."""
    group = [c for c in by if c != "name"]
    total = history.groupBy(*group).agg(F.count_distinct("origin").alias("n_origins"))
    n = history.groupBy(*by).agg(F.count_distinct("origin").alias("n_selected"))
    return n.join(total, group).withColumn("frequency", F.col("n_selected") / F.col("n_origins"))


def effective_window(weights: DataFrame, threshold: float = 1e-12) -> DataFrame:
    """Source rows that carry weight per date of (date, source_pos, pos, weight)."""
    return weights.groupBy("date").agg(F.count_if(F.abs("weight") > threshold).alias("effective_window"))


def recent_weight_share(weights: DataFrame) -> DataFrame:
    """Weight by age of the source row: 0, 1-2, 3-5, 6 and older, future."""
    rel, w = F.col("pos") - F.col("source_pos"), F.col("weight")
    s = lambda c: F.coalesce(F.sum(F.when(c, w)), F.lit(0.0))
    return weights.groupBy("date").agg(
        s(rel == 0).alias("lag_0"), s(rel.between(1, 2)).alias("lag_1_2"), s(rel.between(3, 5)).alias("lag_3_5"), s(rel >= 6).alias("lag_6_plus"), s(rel < 0).alias("future")
    )


def axis_contribution(rows: DataFrame, tags: Sequence[str], fixed_effects: Sequence[str] = ("target", "horizon"), outcome: str = "r2") -> DataFrame:
    """Simple regressions of the outcome on each 0/1 tag after the fixed effects are taken off."""
    w = whole(fixed_effects)
    within = rows.withColumns({c: F.col(c) - F.avg(c).over(w) for c in (outcome, *tags)})
    long = within.unpivot([outcome], list(tags), "tag", "x")
    return long.groupBy("tag").agg(ratio(F.sum(F.col("x") * F.col(outcome)), F.sum(F.col("x") * F.col("x"))).alias("effect"), F.count(F.lit(1)).alias("n"))
