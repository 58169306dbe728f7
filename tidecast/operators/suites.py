"""Suites: whole reports of a panel, of features and of forecasts, and the traces a study leaves."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import analysis, combine, diagnostics, factors, metrics, tests_stat
from ._base import DATE, melt, ordered, value_columns
from .structural import MixedFactorModel


@dataclass
class Report:
    """Tables by name, and what they are of."""

    kind: str
    tables: dict[str, DataFrame]
    metadata: dict[str, object] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def to_dict(self) -> dict[str, DataFrame]:
        return dict(self.tables)


DataAnalysisReport = DataSummaryReport = FeatureDiagnosticReport = ForecastDiagnosticReport = EvaluationReport = Report

# Data.


def panel_snapshot(panel: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: rows, series, cells, missing cells, first and last date."""
    long = melt(panel, value_columns(panel, columns), [DATE])
    return long.agg(
        F.count_distinct(DATE).alias("n_rows"), F.count_distinct("series").alias("n_series"), F.count(F.lit(1)).alias("n_cells"),
        F.count_if(F.col("value").isNull()).alias("n_missing"), F.min(DATE).alias("first"), F.max(DATE).alias("last"),
    )


def panel_snapshots(raw: DataFrame, clean: DataFrame) -> DataFrame:
    return panel_snapshot(raw).withColumn("stage", F.lit("raw")).unionByName(panel_snapshot(clean).withColumn("stage", F.lit("clean")))


def cleaning_effect_summary(raw: DataFrame, clean: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """series: cells that were filled, taken away or changed, and rows that went."""
    a, b = (melt(p, value_columns(p, columns), [DATE]) for p in (raw, clean))
    j = a.select("series", DATE, F.col("value").alias("raw")).join(b.select("series", DATE, F.col("value").alias("clean"), F.lit(1).alias("there")), ["series", DATE], "left")
    return cell_effects(j)


def cell_effects(cells: DataFrame) -> DataFrame:
    """The same of cells series, date, raw, clean, there (null where the row went)."""
    x, y, there = F.col("raw"), F.col("clean"), F.col("there").isNotNull()
    return cells.groupBy("series").agg(
        F.count_if(x.isNull() & y.isNotNull()).alias("n_imputed"), F.count_if(x.isNotNull() & there & y.isNull()).alias("n_removed"),
        F.count_if(x.isNotNull() & y.isNotNull() & (x != y)).alias("n_changed"), F.count_if(~there).alias("n_rows_dropped"),
    )


def mackinnon_pp_pvalue(z_tau: float, n: int, regression: str = "c") -> float:
    """From asymptotic quantiles of the Dickey-Fuller t distribution, between them linearly on the normal scale."""
    from ..functions.stats import norm_cdf, norm_ppf

    #: Tabulated quantiles at these probabilities.
    levels = (0.01, 0.025, 0.05, 0.10, 0.90, 0.95, 0.975, 0.99)
    table = {
        "n": (-2.58, -2.23, -1.95, -1.62, 0.89, 1.28, 1.62, 2.00), "c": (-3.43, -3.12, -2.86, -2.57, -0.44, -0.07, 0.23, 0.60),
        "ct": (-3.96, -3.66, -3.41, -3.12, -1.25, -0.94, -0.66, -0.33),
    }[regression]
    q, z = np.array(table), np.array([norm_ppf(p) for p in levels])
    small = q - {"n": 2.0, "c": 4.0, "ct": 6.0}[regression] / max(n, 10) * (q < -1)  # a shorter sample has a longer lower tail
    i = int(np.clip(np.searchsorted(small, z_tau) - 1, 0, len(q) - 2))
    slope = (z[i + 1] - z[i]) / (small[i + 1] - small[i])
    return float(norm_cdf(z[i] + slope * (z_tau - small[i])))


def summarize_data(panel: DataFrame, columns: Sequence[str] | None = None, correlation: str | None = None, outliers: bool = False, stationarity: bool = False) -> Report:
    long = analysis.long_panel(panel, columns)
    tables = {
        "snapshot": panel_snapshot(panel, columns), "univariate": analysis.univariate_summary(long), "coverage": analysis.sample_coverage(long),
        "missing": analysis.missing_summary(long),
    }
    if correlation:
        tables["correlation"] = analysis.correlation_pairs(long, correlation)
    if outliers:
        tables["outliers"] = analysis.outlier_summary(long)
    if stationarity:
        tables["stationarity"] = factors.stationarity_tests(long)
    return Report("data_summary", tables)


def analyze_data(raw: DataFrame, clean: DataFrame, correlation: str | None = "pearson") -> Report:
    a, b = analysis.long_panel(raw), analysis.long_panel(clean)
    tables = {"snapshots": panel_snapshots(raw, clean), "effects": cleaning_effect_summary(raw, clean), **analysis.compare_panels(a, b)}
    if correlation:
        tables["correlation_shift"] = analysis.correlation_shift(a, b, correlation)
    return Report("data_analysis", tables)


# Features.


def compare_feature_stages(stages: Mapping[str, DataFrame]) -> DataFrame:
    """stage, columns, rows and missing share of panels along a recipe."""
    parts = [panel_snapshot(p).withColumn("stage", F.lit(name)) for name, p in stages.items()]
    out = reduce(DataFrame.unionByName, parts)
    return out.select("stage", "n_rows", "n_series", (F.col("n_missing") / F.col("n_cells")).alias("missing_rate"), "first", "last")


def factor_loadings(panel: DataFrame, source: Sequence[str], factor: Sequence[str]) -> DataFrame:
    """factor, source, correlation, n: one aggregate over the rows both have."""
    pairs = [(f, s) for f in factor for s in source]
    both = lambda f, s: F.col(f).isNotNull() & F.col(s).isNotNull()
    named = [F.struct(F.lit(f).alias("factor"), F.lit(s).alias("source"), F.corr(f, s).alias("loading"), F.count_if(both(f, s)).alias("n")) for f, s in pairs]
    return panel.agg(F.array(*named).alias("a")).select(F.explode("a").alias("r")).select("r.*")


def factor_timeseries(panel: DataFrame, prefixes: Sequence[str] = ("pc", "factor", "maf"), most: int | None = None) -> DataFrame:
    cols = [c for c in value_columns(panel, None) if c.startswith(tuple(prefixes))]
    return melt(panel, cols[:most] if most else cols, [DATE], "factor")


def _lag_columns(columns: Sequence[str], mark: str) -> list[tuple[str, str, int]]:
    out = []
    for c in columns:
        head, _, k = c.rpartition(mark)
        if head and k.isdigit():
            out.append((c, head, int(k)))
    return out


def lag_diagnostics(spark: SparkSession, columns: Sequence[str], mark: str = "_lag") -> DataFrame:
    """source, n_lags, first, last, complete (no lag left out between) of lag columns by their names."""
    rows = spark.createDataFrame(_lag_columns(columns, mark), "column string, source string, lag int")
    g = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_lags"), F.min("lag").alias("first"), F.max("lag").alias("last"))
    return g.withColumn("complete", F.col("n_lags") == F.col("last") - F.col("first") + 1)


def marx_diagnostics(spark: SparkSession, columns: Sequence[str]) -> DataFrame:
    """As ``lag_diagnostics`` for lag means, with the weight that the longest gives its oldest lag."""
    return lag_diagnostics(spark, columns, "_marx").withColumn("least_weight", 1 / F.col("last"))


def lag_autocorrelation(panel: DataFrame, columns: Sequence[str] | None = None, max_lag: int = 12) -> DataFrame:
    """series, lag, acf of lag columns."""
    cols = columns or [c for c, *_ in _lag_columns(value_columns(panel, None), "_lag")]
    return tests_stat.autocorrelations(melt(panel, cols, [DATE]), "value", ("series",), max_lag)


def custom_feature_diagnostic(panel: DataFrame, func: Callable[..., DataFrame], **params) -> DataFrame:
    return func(panel, **params)


def diagnose_features(panel: DataFrame, target: str | None = None, stages: Mapping[str, DataFrame] | None = None, correlation: bool = False, factors_too: bool = False, max_lag: int | None = None) -> Report:
    cols = [c for c in value_columns(panel, None) if c != target]
    long = melt(panel, cols, [DATE])
    tables = {"overview": diagnostics.feature_overview(long), "lags": lag_diagnostics(panel.sparkSession, cols), "marx": marx_diagnostics(panel.sparkSession, cols)}
    if stages:
        tables["stages"] = compare_feature_stages(stages)
    if correlation:
        tables["correlation"] = diagnostics.feature_correlation(long)
    if target:
        tables["target_correlation"] = diagnostics.feature_target_correlation(long, panel.select(DATE, F.col(target).alias("y")))
    if factors_too:
        tables["factor_variance"] = diagnostics.factor_variance(factor_timeseries(panel).withColumnRenamed("factor", "series"))
    if max_lag:
        tables["lag_autocorrelation"] = lag_autocorrelation(panel, max_lag=max_lag)
    return Report("feature_diagnostics", tables)


# Forecasts.


def training_loss_trace(long: DataFrame, arms: Sequence, horizons: Sequence[int] = (1,), first_origin: int = 36, step: int = 1, window: int | None = None) -> DataFrame:
    """target, arm, horizon, origin_pos, n_train, mse, mae of each origin's fit on its own training rows."""
    from .interpret_models import anatomy_model, anatomy_provider, window_to_anatomy_subsets
    from .runner import _design

    held = list(arms)
    schema = "target string, arm string, horizon int, origin_pos int, date date, n_train int, mse double, mae double"

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        arm, h, y, dates, out = held[int(pdf["cell"].iloc[0])], int(pdf["horizon"].iloc[0]), pdf["y"].to_numpy(float), pdf["date"].to_numpy(), []
        z, fit = _design(y, None, arm.lags), anatomy_model(arm)
        for a, b, o in window_to_anatomy_subsets(len(y), first_origin, h, step, window):
            rows = np.arange(a, b)
            ok = np.isfinite(z[rows]).all(1) & np.isfinite(y[rows + h])
            if ok.sum() >= 5:
                e = y[rows + h][ok] - fit(z[rows][ok], y[rows + h][ok])(z[rows][ok])
                out.append((pdf["target"].iloc[0], arm.name, h, o, dates[o], int(ok.sum()), float((e**2).mean()), float(np.abs(e).mean())))
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return anatomy_provider(long, held, horizons).groupBy("target", "cell", "horizon").applyInPandas(work, schema)


def rolling_training_loss(trace: DataFrame, metric: str = "rmse", window: int = 12, min_periods: int | None = None, by: Sequence[str] = ("target", "arm", "horizon")) -> DataFrame:
    w = ordered(by, "origin_pos").rowsBetween(-(window - 1), 0)
    value = F.sqrt(F.avg("mse").over(w)) if metric == "rmse" else F.avg(metric).over(w)
    return trace.withColumn("rolling", F.when(F.count("mse").over(w) >= (window if min_periods is None else min_periods), value))


def _mixed(panel: DataFrame, columns: Sequence[str], quarterly: Sequence[str], options: Mapping, rows_of: Callable, schema: str) -> DataFrame:
    cols = list(columns)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(DATE)
        m = MixedFactorModel(pdf[cols].to_numpy(float), [cols.index(c) for c in quarterly], **options)
        return pd.DataFrame(rows_of(m, [c for c in cols if c not in quarterly], pdf), columns=[c.split()[0] for c in schema.split(", ")])

    return panel.select(DATE, *cols).groupBy().applyInPandas(work, schema)


def dfm_idiosyncratic_acf(panel: DataFrame, columns: Sequence[str], quarterly: Sequence[str] = (), max_lag: int = 12, **options) -> DataFrame:
    """series, lag, acf, n of what the factors leave of each monthly series."""

    def rows(m, names, pdf):
        e = m.idiosyncratic()
        return [(c, d, float(v)) for j, c in enumerate(names) for d, v in zip(pdf[DATE], e[:, j])]

    rest = _mixed(panel, columns, quarterly, options, rows, "series string, date date, value double")
    return tests_stat.autocorrelations(rest, "value", ("series",), max_lag)


def dfm_factor_stability(panel: DataFrame, columns: Sequence[str], quarterly: Sequence[str] = (), **options) -> DataFrame:
    """factor, mean, sd, greatest root of its dynamics, iterations of the estimation."""

    def rows(m, names, pdf):
        root = float(np.abs(np.linalg.eigvals(np.vstack([m.trans, np.eye(4 * m.r, 5 * m.r)]))).max())
        return [(i + 1, float(f.mean()), float(f.std()), root, len(m.trace)) for i, f in enumerate(m.factors.T)]

    return _mixed(panel, columns, quarterly, options, rows, "factor int, mean double, sd double, root double, iterations int")


def tuning_trace(history: DataFrame) -> DataFrame:
    """Selections (target, arm, horizon, origin_pos, kind, name, value) with whether each differs from the one before."""
    w = Window.partitionBy("target", "arm", "horizon", "kind", "name").orderBy("origin_pos")
    before = F.lag("value").over(w)
    return history.where("kind = 'parameter'").withColumn("changed", before.isNotNull() & ~before.eqNullSafe(F.col("value")))


def stage_update_trace(origin_table: DataFrame, policy) -> DataFrame:
    """origin_pos, stage_fit, updated, age of the state in use."""
    from .windows import stage_updates

    t = stage_updates(origin_table, policy)
    return t.select("origin_pos", "stage_fit", (F.col("origin_pos") == F.col("stage_fit")).alias("updated"), (F.col("origin_pos") - F.col("stage_fit")).alias("age"))


def custom_forecast_diagnostic(forecasts: DataFrame, func: Callable[..., DataFrame], **params) -> DataFrame:
    return func(forecasts, **params)


def diagnose_forecasts(forecasts: DataFrame, benchmark: str | None = None, acf_lags: int | None = None, qq: int | None = None, rolling: int | None = None) -> Report:
    tables = {"overview": diagnostics.forecast_overview(forecasts), "residuals": diagnostics.residual_report(forecasts), "first_vs_last": diagnostics.first_vs_last_forecast(forecasts)}
    if acf_lags:
        tables["residual_acf"] = diagnostics.residual_autocorrelation(forecasts, acf_lags)
    if qq:
        tables["residual_qq"] = diagnostics.residual_qq(forecasts, qq)
    if rolling:
        tables["rolling_loss"] = diagnostics.rolling_loss(forecasts, window=rolling)
    if benchmark:
        tables["cumulative"] = diagnostics.cumulative_loss_differential(forecasts, benchmark)
    return Report("forecast_diagnostics", tables)


# Combinations and results as objects.


@dataclass(frozen=True)
class CombinationSpec:
    method: str
    name: str
    models: tuple[str, ...] = ()
    params: Mapping[str, object] = field(default_factory=dict)

    def apply(self, forecasts: DataFrame) -> DataFrame:
        rows = forecasts.where(F.col("model").isin(list(self.models))) if self.models else forecasts
        return combine.METHODS[self.method](rows, **self.params).withColumn("model", F.lit(self.name))


def combination_spec(method: str, name: str | None = None, models: Sequence[str] | None = None, **params) -> CombinationSpec:
    if method not in combine.METHODS:
        raise ValueError(f"unknown combination {method}")
    return CombinationSpec(method, name or f"comb_{method}", tuple(models or ()), params)


def resolve_combinations(value: CombinationSpec | str | Sequence[CombinationSpec | str] | None) -> list[CombinationSpec]:
    many = [] if value is None else [value] if isinstance(value, (str, CombinationSpec)) else list(value)
    out = [combination_spec(v) if isinstance(v, str) else v for v in many]
    if len({c.name for c in out}) != len(out):
        raise ValueError("two combinations have the same name")
    return out


def append_selection_records(spark: SparkSession, path: str, records: Sequence[Mapping[str, object]]) -> None:
    """Selections of an origin (target, arm, horizon, origin_pos, kind, name, value) as JSON lines beside the checkpoint."""
    rows = [(str(r["target"]), str(r["arm"]), int(r["horizon"]), int(r["origin_pos"]), str(r["kind"]), str(r["name"]), str(r["value"])) for r in records]
    spark.createDataFrame(rows, _HISTORY).write.mode("append").json(f"{path}/selections")


_HISTORY = "target string, arm string, horizon int, origin_pos int, kind string, name string, value string"
append_origin_selection_records = append_selection_records


def load_selection_history_frame(spark: SparkSession, path: str) -> DataFrame:
    """All records; of an origin that was written twice, one of each."""
    return spark.read.schema(_HISTORY).json(f"{path}/selections").distinct()


def forecast_panel_origin(panel: DataFrame, columns: Sequence[str], model: str, horizon: int, first_origin: int, step: int = 1, **params) -> DataFrame:
    """target, horizon, origin_pos, date, prediction, actual of a vector model refitted at every origin: all series at once."""
    from .kernels import get_model

    cols, spec = list(columns), get_model(model)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(DATE)
        z, dates, out = pdf[cols].to_numpy(float), pdf[DATE].to_numpy(), []
        for o in range(first_origin, len(z) - horizon, step):
            past = z[: o + 1]
            past = past[np.isfinite(past).all(1)]
            path = spec.fit(past, horizon, **params)
            out += [(c, horizon, o, dates[o + horizon], float(path[horizon - 1, j]), float(z[o + horizon, j])) for j, c in enumerate(cols)]
        return pd.DataFrame(out, columns=["target", "horizon", "origin_pos", "date", "prediction", "actual"])

    return panel.select(DATE, *cols).groupBy().applyInPandas(work, "target string, horizon int, origin_pos int, date date, prediction double, actual double")


@dataclass
class ForecastResult:
    """A forecast table with what was made beside it."""

    forecasts: DataFrame
    metadata: dict[str, object] = field(default_factory=dict)
    sidecars: dict[str, object] = field(default_factory=dict)

    def to_frame(self) -> DataFrame:
        return self.forecasts

    def evaluate(self, benchmark: str) -> DataFrame:
        return metrics.benchmark_comparison(self.forecasts, benchmark)

    def with_sidecar(self, name: str, value: object) -> ForecastResult:
        return ForecastResult(self.forecasts, self.metadata, {**self.sidecars, name: value})

    def get_sidecar(self, name: str) -> object:
        return self.sidecars[name]

    def sidecar_names(self) -> list[str]:
        return sorted(self.sidecars)


# Filters as objects.


@dataclass(frozen=True)
class FilterResult:
    frame: DataFrame
    method: str
    params: Mapping[str, object] = field(default_factory=dict)


AlbaMAResult = FilterResult


@dataclass(frozen=True)
class AdaptiveMovingAverage:
    n_estimators: int = 100
    min_samples_leaf: int = 6
    random_state: int = 0

    def filter(self, panel: DataFrame, column: str, by: Sequence[str] = ()) -> FilterResult:
        out = factors.albama(panel, column, self.n_estimators, self.min_samples_leaf, by, self.random_state)
        return FilterResult(out, "albama", {"n_estimators": self.n_estimators, "min_samples_leaf": self.min_samples_leaf})


# Trading helpers of forests with local regressions.


def split_preference(sse: Sequence[float], preference: float = 0.25) -> np.ndarray:
    """Squared errors of ordered cuts with a penalty that grows toward both ends."""
    v = np.asarray(sse, float)
    at = (np.arange(len(v)) + 0.5) / len(v) - 0.5
    return v * (1 + preference * 4 * at**2)


DV_fun = split_preference


def standard(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = np.asarray(x, float)
    s = v.std(0)
    return (v - v.mean(0)) / np.where(s > 0, s, 1), v.mean(0), s


def collect_errors(forecasts: DataFrame) -> DataFrame:
    return forecasts.withColumn("error_value", F.col("actual") - F.col("prediction"))


def get_MAE(errors: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:  # noqa: N802
    return errors.groupBy(*by).agg(F.avg(F.abs("error_value")).alias("mae"))


def get_MSE(errors: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:  # noqa: N802
    return errors.groupBy(*by).agg(F.avg(F.col("error_value") * F.col("error_value")).alias("mse"))


def trading_strategy(forecasts: DataFrame, by: Sequence[str] = ("target", "model")) -> DataFrame:
    """Long a unit when the forecast is above the last actual, short below: daily and cumulative profit."""
    w = ordered(by)
    before = F.lag("actual").over(w)
    rows = forecasts.withColumn("profit", F.signum(F.col("prediction") - before) * (F.col("actual") - before)).where("profit IS NOT NULL")
    return rows.withColumn("cumulative", F.sum("profit").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def trading_summary(profits: DataFrame, by: Sequence[str] = ("target", "model"), periods: int = 252) -> DataFrame:
    """Sharpe ratio, greatest drawdown and its date, annual profit."""
    top = F.max("cumulative").over(ordered(by).rowsBetween(Window.unboundedPreceding, 0))
    rows = profits.withColumn("drawdown", F.col("cumulative") - top)
    n = F.count(F.lit(1))
    return rows.groupBy(*by).agg(
        (F.avg("profit") / F.when(F.stddev_samp("profit") > 0, F.stddev_samp("profit")) * float(np.sqrt(periods))).alias("sharpe_ratio"),
        F.min("drawdown").alias("max_drawdown"), F.min_by(DATE, "drawdown").alias("max_drawdown_date"), (F.sum("profit") * periods / n).alias("annual_profit"),
    )


get_sharpe_ratio = get_max_dd_and_date = get_annualised_return = trading_summary
