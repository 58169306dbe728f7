"""Cleaning, imputation, scaling and stationarity codes of a panel.

Statistics are fitted per key (``by``) as window aggregates over the key or, for
a reusable state, as one aggregate row per key that is joined back.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._base import DATE, PanelError, ordered, ratio, value_columns, whole

LOG_CODES = (4, 5, 6)
TINY = 1e-6


def _quantile(c: str, q: float, by: Sequence[str]) -> Column:
    return F.percentile(c, F.lit(q)).over(whole(by))


def _act(c: str, low: Column, high: Column, bad: Column, action: str, by: Sequence[str]) -> Column:
    x = F.col(c)
    if action == "flag_as_nan":
        return F.when(~F.coalesce(bad, F.lit(False)), x)
    if action == "replace_with_median":
        return F.when(F.coalesce(bad, F.lit(False)), F.median(c).over(whole(by))).otherwise(x)
    if action == "replace_with_cap_value":
        capped = F.least(F.greatest(x, _quantile(c, 0.01, by)), _quantile(c, 0.99, by))
        return F.when(F.coalesce(bad, F.lit(False)), capped).otherwise(x)
    raise PanelError(f"unknown action {action}")


def iqr_outlier_clean(panel: DataFrame, columns: Sequence[str] | None = None, threshold: float = 10.0, action: str = "flag_as_nan", by: Sequence[str] = ()) -> DataFrame:
    """|x - median| above ``threshold`` interquartile ranges; never where that range is zero."""
    out = {}
    for c in value_columns(panel, columns, by):
        q = F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(whole(by))
        spread = q[2] - q[0]
        bad = (spread > 0) & (F.abs(F.col(c) - q[1]) > threshold * spread)
        out[c] = _act(c, q[0], q[2], bad, action, by)
    return panel.withColumns(out)


def zscore_outlier_clean(panel: DataFrame, columns: Sequence[str] | None = None, threshold: float = 3.0, action: str = "flag_as_nan", by: Sequence[str] = ()) -> DataFrame:
    out = {}
    for c in value_columns(panel, columns, by):
        m, s = F.avg(c).over(whole(by)), F.stddev_pop(c).over(whole(by))
        bad = (s > 0) & (F.abs(F.col(c) - m) > threshold * s)
        out[c] = _act(c, m, m, bad, action, by)
    return panel.withColumns(out)


def winsorize_clean(panel: DataFrame, columns: Sequence[str] | None = None, lower_quantile: float = 0.01, upper_quantile: float = 0.99, by: Sequence[str] = ()) -> DataFrame:
    return panel.withColumns({
        c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), _quantile(c, lower_quantile, by)), _quantile(c, upper_quantile, by)))
        for c in value_columns(panel, columns, by)
    })


def mean_impute_clean(panel: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    return panel.withColumns({c: F.coalesce(c, F.avg(c).over(whole(by))) for c in value_columns(panel, columns, by)})


def forward_fill_clean(panel: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    w = ordered(by).rowsBetween(Window.unboundedPreceding, 0)
    return panel.withColumns({c: F.last(c, True).over(w) for c in value_columns(panel, columns, by)})


def linear_interpolate_clean(panel: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Between observed rows only, by row position."""
    back = ordered(by).rowsBetween(Window.unboundedPreceding, 0)
    ahead = ordered(by).rowsBetween(0, Window.unboundedFollowing)
    cols = value_columns(panel, columns, by)
    pos = panel.withColumn("_pos", F.row_number().over(ordered(by)).cast("double"))
    out = {}
    for c in cols:
        at = F.when(F.col(c).isNotNull(), F.col("_pos"))
        p0, p1 = F.last(at, True).over(back), F.first(at, True).over(ahead)
        v0, v1 = F.last(c, True).over(back), F.first(c, True).over(ahead)
        out[c] = F.coalesce(F.col(c), v0 + (v1 - v0) * ratio(F.col("_pos") - p0, p1 - p0))
    return pos.withColumns(out).drop("_pos")


def truncate_to_balanced_clean(panel: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    return panel.dropna("any", subset=value_columns(panel, columns, by))


def drop_unbalanced_series_clean(panel: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Columns with any missing cell go (one aggregate row comes to the driver)."""
    cols = value_columns(panel, columns, by)
    gaps = panel.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
    return panel.drop(*[c for c in cols if gaps[c]])


def drop_unbalanced_keys(panel: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """The long-panel form: keys with any missing cell go."""
    gap = F.max(F.greatest(*[F.col(c).isNull() for c in columns], F.lit(False))).over(whole(by))
    return panel.withColumn("_gap", gap).where(~F.col("_gap")).drop("_gap")


def zero_fill_leading_clean(panel: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    return panel.fillna(0.0, subset=value_columns(panel, columns, by))


def handle_frame_edges(panel: DataFrame, method: str = "keep", columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    return {
        "keep": lambda p, c, b: p, "truncate_to_balanced": truncate_to_balanced_clean,
        "drop_unbalanced_series": drop_unbalanced_series_clean, "zero_fill_leading": zero_fill_leading_clean,
    }[method](panel, columns, by)


def _centre_scale(c: str, method: str, ddof: int, over: Callable[[Column], Column]) -> tuple[Column, Column]:
    if method == "zscore":
        return over(F.avg(c)), over(F.stddev_pop(c) if ddof == 0 else F.stddev_samp(c))
    if method == "robust":
        q = over(F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))))
        return q[1], q[2] - q[0]
    if method == "minmax":
        return over(F.min(c)), over(F.max(c)) - over(F.min(c))
    raise PanelError(f"unknown method {method}")


def fit_standardization_state(panel: DataFrame, columns: Sequence[str] | None = None, method: str = "zscore", ddof: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """One row per key: ``c_center`` and ``c_scale`` of each column."""
    out = []
    for c in value_columns(panel, columns, by):
        centre, scale = _centre_scale(c, method, ddof, lambda x: x)
        out += [centre.alias(f"{c}_center"), scale.alias(f"{c}_scale")]
    return panel.groupBy(*by).agg(*out)


def apply_standardization_state(panel: DataFrame, state: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """A zero scale is an error where it meets a row."""
    joined = panel.join(state, list(by)) if by else panel.crossJoin(F.broadcast(state))  # one row
    scaled = {}
    for c in columns:
        s = F.col(f"{c}_scale")
        s = F.when(s == 0, F.raise_error(F.lit(f"zero scale: {c}")).cast("double")).otherwise(s)
        scaled[c] = (F.col(c) - F.col(f"{c}_center")) / s
    return joined.withColumns(scaled).select(*panel.columns)


def standardize_clean(panel: DataFrame, columns: Sequence[str] | None = None, method: str = "zscore", ddof: int = 0, by: Sequence[str] = ()) -> DataFrame:
    cols = value_columns(panel, columns, by)
    return apply_standardization_state(panel, fit_standardization_state(panel, cols, method, ddof, by), cols, by)


def standardize_panel(panel: DataFrame, scope_end: str, columns: Sequence[str] | None = None, method: str = "zscore", by: Sequence[str] = ()) -> DataFrame:
    """State fitted on rows up to ``scope_end``, applied to all."""
    cols = value_columns(panel, columns, by)
    seen = panel.where(F.col(DATE) <= F.lit(scope_end).cast("date"))
    return apply_standardization_state(panel, fit_standardization_state(seen, cols, method, 0, by), cols, by)


def tcode(c: str, code: int, by: Sequence[str] = ()) -> Column:
    """Stationarity code 1-7; a log code makes the whole series NULL if its least value is tiny."""
    w = ordered(by)
    x = F.col(c)
    lag1, lag2 = F.lag(c, 1).over(w), F.lag(c, 2).over(w)
    safe = F.min(c).over(whole(by)) >= TINY
    ln = lambda v: F.when(safe & (v > 0), F.ln(v))
    return {
        1: x, 2: x - lag1, 3: x - 2 * lag1 + lag2, 4: ln(x), 5: ln(x) - ln(lag1), 6: ln(x) - 2 * ln(lag1) + ln(lag2),
        7: (ratio(x, lag1) - 1) - (ratio(lag1, lag2) - 1),
    }[code]


def apply_tcode_transform(panel: DataFrame, codes: Mapping[str, int], by: Sequence[str] = ()) -> DataFrame:
    return panel.withColumns({c: tcode(c, k, by) for c, k in codes.items()})


apply_transform_codes = apply_tcode_transform
#: Rows that a code loses at the start.
TCODE_LAGS = {1: 0, 2: 1, 3: 2, 4: 0, 5: 1, 6: 2, 7: 2}


def handle_tcode_lag(panel: DataFrame, codes: Mapping[str, int], method: str = "drop", by: Sequence[str] = ()) -> DataFrame:
    n = max((TCODE_LAGS[k] for k in codes.values()), default=0)
    if method == "keep" or not n:
        return panel
    return panel.withColumn("_pos", F.row_number().over(ordered(by))).where(F.col("_pos") > n).drop("_pos")


def handle_outliers(panel: DataFrame, method: str = "iqr", columns: Sequence[str] | None = None, by: Sequence[str] = (), **options: object) -> DataFrame:
    if method == "none":
        return panel
    return {"iqr": iqr_outlier_clean, "zscore": zscore_outlier_clean, "winsorize": winsorize_clean}[method](panel, columns, by=by, **options)


def impute_missing(panel: DataFrame, method: str = "em_factor", columns: Sequence[str] | None = None, by: Sequence[str] = (), **options: object) -> DataFrame:
    if method == "none":
        return panel
    if method in ("em_factor", "em_multivariate"):
        from .factors import em_factor_impute, em_multivariate_impute

        return (em_factor_impute if method == "em_factor" else em_multivariate_impute)(panel, columns, by=by, **options)
    return {"mean": mean_impute_clean, "forward_fill": forward_fill_clean, "linear_interpolation": linear_interpolate_clean}[method](panel, columns, by)


def inverse_box_cox(c: Column, lmbda: float) -> Column:
    return F.exp(c) if lmbda == 0 else F.pow(lmbda * c + 1, 1 / lmbda)


def box_cox(c: Column, lmbda: float) -> Column:
    return F.when(c > 0, F.ln(c) if lmbda == 0 else (F.pow(c, lmbda) - 1) / lmbda)


@dataclass(frozen=True)
class PreprocessSpec:
    """An ordered recipe; ``fit`` freezes the scaling state on the rows it sees."""

    codes: Mapping[str, int]
    outliers: str = "iqr"
    outlier_action: str = "flag_as_nan"
    impute: str = "forward_fill"
    standardize: str | None = "zscore"
    edges: str = "keep"
    by: tuple[str, ...] = ()

    def _prepared(self, panel: DataFrame) -> DataFrame:
        cols = list(self.codes)
        out = handle_tcode_lag(apply_tcode_transform(panel, self.codes, self.by), self.codes, "drop", self.by)
        options = {"action": self.outlier_action} if self.outliers in ("iqr", "zscore") else {}
        out = handle_outliers(out, self.outliers, cols, self.by, **options)
        return impute_missing(out, self.impute, cols, self.by)

    def fit(self, panel: DataFrame) -> FittedPreprocessor:
        state = fit_standardization_state(self._prepared(panel), list(self.codes), self.standardize, 0, self.by) if self.standardize else None
        return FittedPreprocessor(self, state)

    def fit_transform(self, panel: DataFrame) -> DataFrame:
        return self.fit(panel).transform(panel)


@dataclass(frozen=True)
class FittedPreprocessor:
    spec: PreprocessSpec
    state: DataFrame | None

    def transform(self, panel: DataFrame) -> DataFrame:
        out, cols = self.spec._prepared(panel), list(self.spec.codes)
        if self.state is not None:
            out = apply_standardization_state(out, self.state, cols, self.spec.by)
        return handle_frame_edges(out, self.spec.edges, cols, self.spec.by)


def reprocess(panel: DataFrame, codes: Mapping[str, int], by: Sequence[str] = (), **options: object) -> DataFrame:
    return PreprocessSpec(dict(codes), by=tuple(by), **options).fit_transform(panel)


def custom_preprocess(panel: DataFrame, func: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return panel.transform(func)


def box_cox_lambda(y, method: str = "loglik", period: int = 12, bounds: tuple[float, float] = (-1.0, 2.0)) -> float:
    """The parameter of greatest profile likelihood, or of least variation of spread over level across periods (``guerrero``)."""
    import numpy as np

    v = np.asarray(y, float)
    v = v[np.isfinite(v)]
    if (v <= 0).any() or len(v) < 3:
        raise ValueError("three positive values or more are needed")
    logs = np.log(v)

    def cost(k: float) -> float:
        if method == "guerrero":
            blocks = v[len(v) % period :].reshape(-1, period)
            ratio = blocks.std(1, ddof=1) / blocks.mean(1) ** (1 - k)
            return float(ratio.std(ddof=1) / ratio.mean())
        z = logs if abs(k) < 1e-10 else np.expm1(k * logs) / k
        return float(len(v) / 2 * np.log(max(z.var(), 1e-300)) - (k - 1) * logs.sum())

    if method not in ("loglik", "guerrero") or (method == "guerrero" and len(v) < 2 * period):
        raise ValueError("method is loglik, or guerrero with two periods or more")
    grid = np.linspace(*bounds, 61)
    k = int(np.argmin([cost(g) for g in grid]))
    a, b, gold = grid[max(k - 1, 0)], grid[min(k + 1, 60)], (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - gold * (b - a), a + gold * (b - a)
        a, b = (a, d) if cost(c) < cost(d) else (c, b)
    return float((a + b) / 2)


def fred_sd_transform_codes(columns: Sequence[str], national: Mapping[str, int], analog: Mapping[str, str], own: Mapping[str, int] | None = None) -> dict[str, int]:
    """A code for every ``<variable>_<state>`` column: its own, that of its variable, or that of the variable's national series."""
    named, out = dict(own or {}), {}
    for c in columns:
        variable = c.rsplit("_", 1)[0]
        code = named.get(c, named.get(variable, national.get(analog.get(variable, variable))))
        if code is not None:
            out[c] = int(code)
    return out


class UndigestiblePreprocessorSpec(TypeError):
    """A recipe holds what cannot be told apart by its text, such as a function."""


@dataclass(frozen=True)
class PreprocessedData:
    panel: DataFrame
    spec: PreprocessSpec
    state: DataFrame | None = None

    def report(self) -> DataFrame:
        return report(self.panel)


def plan(spec: PreprocessSpec) -> list[tuple[str, str]]:
    """What a recipe will do, step by step, without doing it."""
    steps = [("transform", f"{len(spec.codes)} columns"), ("lag rows", "drop"), ("outliers", f"{spec.outliers}, {spec.outlier_action}"), ("impute", spec.impute)]
    return [*steps, *([("standardize", spec.standardize)] if spec.standardize else []), ("edges", spec.edges)]


def report(panel: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """series, n, n_missing, mean, sd, first, last of a processed panel."""
    cols = value_columns(panel, columns)
    long = panel.unpivot([DATE], cols, "series", "value")
    seen = F.when(F.col("value").isNotNull(), F.col(DATE))
    return long.groupBy("series").agg(
        F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("n_missing"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min(seen).alias("first"), F.max(seen).alias("last")
    )


class PreprocessorStore:
    """Scaling states of fitted recipes as Parquet, under a digest of recipe and data."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    @staticmethod
    def key(spec: PreprocessSpec, data_identity: str) -> str:
        import hashlib
        import json
        from dataclasses import asdict

        try:
            said = json.dumps({"spec": asdict(spec), "data": data_identity}, sort_keys=True)
        except TypeError as e:
            raise UndigestiblePreprocessorSpec(str(e)) from e
        return hashlib.sha256(said.encode()).hexdigest()

    def put(self, fitted: FittedPreprocessor, data_identity: str) -> str:
        k = self.key(fitted.spec, data_identity)
        if fitted.state is not None:
            fitted.state.write.mode("overwrite").parquet(f"{self.path}/{k}")
        return k

    def get(self, spec: PreprocessSpec, data_identity: str) -> FittedPreprocessor | None:
        """The fitted recipe, or None if it has not been kept."""
        from pyspark.errors import AnalysisException

        if not spec.standardize:
            return FittedPreprocessor(spec, None)
        try:
            return FittedPreprocessor(spec, self.spark.read.parquet(f"{self.path}/{self.key(spec, data_identity)}"))
        except AnalysisException:
            return None
