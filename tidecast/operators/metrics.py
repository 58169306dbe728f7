"""Forecast accuracy as aggregate expressions over a long forecast table.

Every metric is a Column to be used in ``groupBy(...).agg(...)``; rows where a
needed value is missing do not count.  Forecast tables have the columns target,
horizon, origin, date, model, prediction and actual.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from math import pi

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._base import ratio, upto, whole

KEYS = ("target", "horizon")
A, P = "actual", "prediction"


def _pair(a: str = A, p: str = P) -> tuple[Column, Column]:
    """Both values where both are there."""
    both = F.col(a).isNotNull() & F.col(p).isNotNull()
    return F.when(both, F.col(a)), F.when(both, F.col(p))


def _error(a: str = A, p: str = P) -> Column:
    return F.col(a) - F.col(p)


def mse(a: str = A, p: str = P) -> Column:
    return F.avg(F.pow(_error(a, p), 2))


def rmse(a: str = A, p: str = P) -> Column:
    return F.sqrt(mse(a, p))


def mae(a: str = A, p: str = P) -> Column:
    return F.avg(F.abs(_error(a, p)))


def bias(a: str = A, p: str = P) -> Column:
    return F.avg(_error(a, p))


def medae(a: str = A, p: str = P) -> Column:
    return F.median(F.abs(_error(a, p)))


def mape(a: str = A, p: str = P, eps: float = 1e-10) -> Column:
    floor = F.when(F.abs(a) < eps, F.lit(eps)).otherwise(F.abs(a))
    return F.avg(F.abs(_error(a, p)) / floor) * 100


def smape(a: str = A, p: str = P, eps: float = 1e-10) -> Column:
    return F.avg(F.abs(_error(a, p)) / F.greatest((F.abs(a) + F.abs(p)) / 2, F.lit(eps))) * 100


def theil_u1(a: str = A, p: str = P) -> Column:
    x, y = _pair(a, p)
    return ratio(rmse(a, p), F.sqrt(F.avg(x * x)) + F.sqrt(F.avg(y * y)))


def theil_u2(a: str = A, p: str = P, prev: str = "previous_actual") -> Column:
    own = F.pow(ratio(F.col(p) - F.col(a), F.col(prev)), 2)
    naive = F.pow(ratio(F.col(a) - F.col(prev), F.col(prev)), 2)
    return F.sqrt(ratio(F.sum(F.when(naive.isNotNull(), own)), F.sum(F.when(own.isNotNull(), naive))))


def pinball_loss(quantile: float, a: str = A, q: str = P) -> Column:
    e = _error(a, q)
    return F.avg(F.greatest(quantile * e, (quantile - 1) * e))


def negative_log_score(a: str = A, p: str = P, variance: str = "variance_prediction") -> Column:
    v = F.when(F.col(variance) > 0, F.col(variance))
    return F.avg(0.5 * (F.ln(2 * pi * v) + F.pow(_error(a, p), 2) / v))


gaussian_nll = log_score = negative_log_score


def qlike(a: str = A, variance: str = "variance_prediction", eps: float = 1e-12) -> Column:
    v = F.greatest(F.col(variance), F.lit(eps))
    return F.avg(F.ln(v) + F.pow(F.col(a), 2) / v)


def coverage_rate(a: str = A, lower: str = "lower", upper: str = "upper") -> Column:
    return F.avg(F.col(a).between(F.col(lower), F.col(upper)).cast("double"))


def interval_width(lower: str = "lower", upper: str = "upper") -> Column:
    return F.avg(F.col(upper) - F.col(lower))


def interval_score(a: str = A, lower: str = "lower", upper: str = "upper", alpha: float = 0.05) -> Column:
    lo, hi, y = F.col(lower), F.col(upper), F.col(a)
    under, over = F.when(y < lo, lo - y).otherwise(0.0), F.when(y > hi, y - hi).otherwise(0.0)
    return F.avg(F.when(y.isNotNull(), hi - lo + 2 / alpha * (under + over)))


def success_ratio(a: str = A, p: str = P, prev: str = "previous_actual") -> Column:
    hit = F.signum(F.col(p) - F.col(prev)) == F.signum(F.col(a) - F.col(prev))
    return F.when(F.count(hit) >= 2, F.avg(hit.cast("double")))


def crps_row(a: str = A, p: str = P, variance: str = "variance_prediction") -> Column:
    """Row-wise Gaussian CRPS (an Arrow function: SQL has no error function)."""
    @F.pandas_udf("double")
    def crps(y: pd.Series, m: pd.Series, v: pd.Series) -> pd.Series:
        from ..functions.stats import norm_cdf, norm_pdf

        s = v.where(v > 0) ** 0.5
        z = (y - m) / s
        return s * (z * (2 * norm_cdf(z) - 1) + 2 * norm_pdf(z) - pi**-0.5)

    return crps(F.col(a).cast("double"), F.col(p).cast("double"), F.col(variance).cast("double"))


POINT: dict[str, Callable[[], Column]] = {
    "mse": mse, "rmse": rmse, "mae": mae, "bias": bias, "medae": medae, "mape": mape, "smape": smape, "theil_u1": theil_u1,
}
DIRECTION = {"success_ratio": success_ratio, "theil_u2": theil_u2}
DENSITY = {"negative_log_score": negative_log_score, "qlike": qlike}
HIGHER_IS_BETTER = {"success_ratio", "r2_oos", "coverage_rate", "sharpe_ratio", "mse_reduction"}


def get_metric(metric: str) -> Column:
    return {**POINT, **DIRECTION, **DENSITY}[metric]()


def metric_kind(metric: str) -> str:
    return "point" if metric in POINT else "direction" if metric in DIRECTION else "density" if metric in DENSITY else "relative"


def compute_point_loss(loss: str = "squared_error", quantile: float | None = None, a: str = A, p: str = P) -> Column:
    """Row-level loss."""
    e = _error(a, p)
    if loss == "squared_error":
        return e * e
    if loss == "absolute_error":
        return F.abs(e)
    if loss == "pinball":
        return F.greatest(quantile * e, (quantile - 1) * e)
    raise ValueError(f"unknown loss {loss}")


def mad(forecasts: DataFrame, by: Sequence[str] = ("model", "horizon")) -> DataFrame:
    """Median absolute deviation of the errors from their median."""
    e = forecasts.withColumn("_e", _error()).withColumn("_m", F.median("_e").over(whole(by)))
    return e.groupBy(*by).agg(F.median(F.abs(F.col("_e") - F.col("_m"))).alias("mad"))


def evaluate_forecasts(forecasts: DataFrame, by: Sequence[str] = ("model", "horizon"), metrics: Sequence[str] = ("mse", "rmse", "mae")) -> DataFrame:
    """One row per group; direction and density metrics join in where their columns exist."""
    wanted = list(metrics)
    if "previous_actual" in forecasts.columns:
        wanted += [m for m in DIRECTION if m not in wanted]
    if "variance_prediction" in forecasts.columns:
        wanted += [m for m in DENSITY if m not in wanted]
    n = F.count_if(F.col(A).isNotNull() & F.col(P).isNotNull()).alias("n")
    return forecasts.groupBy(*by).agg(*[get_metric(m).alias(m) for m in wanted], n)


def rank_forecasts(evaluation: DataFrame, metric: str = "mse", by: Sequence[str] = ("horizon",), rank_column: str = "rank") -> DataFrame:
    """Ties share the smallest rank; a missing metric has none."""
    order = F.col(metric).desc_nulls_last() if metric in HIGHER_IS_BETTER else F.col(metric).asc_nulls_last()
    return evaluation.withColumn(rank_column, F.when(F.col(metric).isNotNull(), F.rank().over(Window.partitionBy(*by).orderBy(order))))


def with_benchmark(forecasts: DataFrame, benchmark: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows with the benchmark's prediction for the same target, horizon and date, where all three values exist."""
    b = forecasts.where(F.col("model") == benchmark).select(*keys, "date", F.col(P).alias("benchmark_prediction"))
    joined = forecasts.join(b, [*keys, "date"])
    return joined.where(F.col(A).isNotNull() & F.col(P).isNotNull() & F.col("benchmark_prediction").isNotNull())


def benchmark_comparison(forecasts: DataFrame, benchmark: str, by: Sequence[str] = ("target", "horizon", "model")) -> DataFrame:
    """rmse, relative_mse, relative_mae, mse_reduction, r2_oos, n on rows shared with the benchmark."""
    g = with_benchmark(forecasts, benchmark).groupBy(*by).agg(
        mse().alias("_m"), mse(p="benchmark_prediction").alias("_b"), mae().alias("_am"), mae(p="benchmark_prediction").alias("_ab"),
        F.count(F.lit(1)).alias("n"),
    )
    rel = F.when(F.col("_b") > 0, F.col("_m") / F.when(F.col("_b") > 0, F.col("_b")))
    return g.select(
        *by, F.sqrt("_m").alias("rmse"), rel.alias("relative_mse"), ratio(F.col("_am"), F.col("_ab")).alias("relative_mae"),
        (F.col("_b") - F.col("_m")).alias("mse_reduction"), (1 - rel).alias("r2_oos"), "n",
    )


def seasonal_naive_mae(train: DataFrame, column: str, m: int = 1, by: Sequence[str] = ()) -> DataFrame:
    from ._base import ordered

    return train.withColumn("_d", F.abs(F.col(column) - F.lag(column, m).over(ordered(by)))).groupBy(*by).agg(F.avg("_d").alias("scale"))


def mase(forecasts: DataFrame, scale: DataFrame, on: Sequence[str] = ("target",), by: Sequence[str] = ("target", "horizon", "model")) -> DataFrame:
    g = forecasts.groupBy(*by).agg(mae().alias("mae"))
    return g.join(scale, list(on)).select(*by, ratio(F.col("mae"), F.col("scale")).alias("mase"))


def acf1(df: DataFrame, column: str, by: Sequence[str] = (), order: str = "date") -> DataFrame:
    """Biased lag-1 autocorrelation."""
    from ._base import ordered

    d = df.withColumn("_d", F.col(column) - F.avg(column).over(whole(by)))
    d = d.withColumn("_l", F.lag("_d").over(ordered(by, order)))
    return d.groupBy(*by).agg(ratio(F.sum(F.col("_d") * F.col("_l")), F.sum(F.col("_d") * F.col("_d"))).alias("acf1"))


def forecast_returns(forecasts: DataFrame, benchmark: str, loss: str = "squared_error") -> DataFrame:
    """Benchmark loss less model loss per date."""
    gain = compute_point_loss(loss, p="benchmark_prediction") - compute_point_loss(loss)
    return with_benchmark(forecasts, benchmark).where(F.col("model") != benchmark).select(*KEYS, "model", "date", gain.alias("forecast_return"))


def drawdown_series(returns: DataFrame, by: Sequence[str] = (*KEYS, "model"), column: str = "forecast_return") -> DataFrame:
    c = returns.withColumn("cumulative", F.sum(column).over(upto(by)))
    return c.withColumn("drawdown", F.col("cumulative") - F.max("cumulative").over(upto(by)))


def risk_adjusted_forecast_metrics(returns: DataFrame, by: Sequence[str] = (*KEYS, "model"), column: str = "forecast_return") -> DataFrame:
    """sharpe_ratio, sortino_ratio, omega_ratio, max_drawdown, n per group."""
    r = F.col(column)
    return drawdown_series(returns, by, column).groupBy(*by).agg(
        ratio(F.avg(r), F.stddev_samp(r)).alias("sharpe_ratio"),
        ratio(F.avg(r), F.sqrt(F.avg(F.pow(F.least(r, F.lit(0.0)), 2)))).alias("sortino_ratio"),
        ratio(F.sum(F.greatest(r, F.lit(0.0))), F.sum(F.greatest(-r, F.lit(0.0)))).alias("omega_ratio"),
        F.min("drawdown").alias("max_drawdown"), F.count(r).alias("n"),
    )


def edge_ratio(forecasts: DataFrame, keys: Sequence[str] = KEYS, loss: str = "squared_error") -> DataFrame:
    """Gains over the best other model on each date against losses to it; (M - 1) times their ratio."""
    rows = forecasts.withColumn("_l", compute_point_loss(loss)).where("_l IS NOT NULL")
    at = Window.partitionBy(*keys, "date")
    rows = rows.withColumn("_two", F.slice(F.array_sort(F.collect_list("_l").over(at)), 1, 2)).withColumn("_n", F.count(F.lit(1)).over(at))
    least, second = F.get("_two", F.lit(0)), F.get("_two", F.lit(1))
    other = F.when(F.col("_l") > least, least).otherwise(second)  # a tie of the best is its own best other
    edge = other - F.col("_l")
    return rows.where("_n > 1").groupBy(*keys, "model").agg(
        (ratio(F.sum(F.greatest(edge, F.lit(0.0))), F.sum(F.greatest(-edge, F.lit(0.0)))) * (F.max("_n") - 1)).alias("edge_ratio")
    )


def error_decomposition(forecasts: DataFrame, by: Sequence[str] = ("target", "horizon", "model")) -> DataFrame:
    """mse = bias² + variance, and their shares."""
    g = forecasts.groupBy(*by).agg(mse().alias("mse"), F.pow(bias(), 2).alias("bias_sq"), F.var_pop(_error()).alias("variance"), F.count(_error()).alias("n"))
    return g.withColumns({"bias_share": ratio(F.col("bias_sq"), F.col("mse")), "variance_share": ratio(F.col("variance"), F.col("mse"))})


def aggregate_scores(forecasts: DataFrame, groupings: Mapping[str, Sequence[str]], metrics: Sequence[str] = ("mse", "rmse", "mae")) -> dict[str, DataFrame]:
    return {name: evaluate_forecasts(forecasts, by, metrics) for name, by in groupings.items()}


def grouping_sets_scores(forecasts: DataFrame, dims: Sequence[str] = ("target", "horizon", "model"), metrics: Sequence[str] = ("mse", "mae")) -> DataFrame:
    """All roll-ups of the dimensions in one pass."""
    return forecasts.rollup(*dims).agg(F.grouping_id().cast("int").alias("level"), *[get_metric(m).alias(m) for m in metrics], F.count(_error()).alias("n"))


def regime_scores(forecasts: DataFrame, regimes: DataFrame, by: Sequence[str] = ("model", "horizon"), metrics: Sequence[str] = ("mse", "mae")) -> DataFrame:
    return evaluate_forecasts(forecasts.join(regimes, "date"), [*by, "regime"], metrics)


def filter_oos_period(forecasts: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    out = forecasts
    if start:
        out = out.where(F.col("date") >= F.lit(start).cast("date"))
    return out.where(F.col("date") <= F.lit(end).cast("date")) if end else out


def evaluate_report(forecasts: DataFrame, benchmark: str, metrics: Sequence[str] = ("mse", "rmse", "mae"), regimes: DataFrame | None = None) -> dict[str, DataFrame]:
    scores = evaluate_forecasts(forecasts, ("target", "horizon", "model"), metrics)
    out = {
        "scores": scores, "ranking": rank_forecasts(scores, metrics[0], KEYS), "benchmark": benchmark_comparison(forecasts, benchmark),
        "decomposition": error_decomposition(forecasts),
    }
    return out | ({"regime": regime_scores(forecasts, regimes)} if regimes is not None else {})
