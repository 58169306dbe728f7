"""Features and targets as window expressions; one sort per key serves all columns of a call."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from itertools import combinations, combinations_with_replacement
from math import pi

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._base import DATE, melt, ordered, ratio, trailing, upto, value_columns, whole


def _added(df: DataFrame, new: Mapping[str, Column], drop_missing: bool = False) -> DataFrame:
    out = df.withColumns(dict(new))
    return out.dropna("any", subset=list(new)) if drop_missing else out


def full_mean(c: str, n: int, by: Sequence[str] = (), shift: int = 0, min_periods: int | None = None) -> Column:
    """Mean of ``n`` rows, NULL with fewer than ``min_periods`` (default: all) observed."""
    w = trailing(n, by, shift=shift)
    return F.when(F.count(c).over(w) >= (n if min_periods is None else min_periods), F.avg(c).over(w))


def lag(df: DataFrame, columns: Sequence[str] | None = None, lags: Sequence[int] = (1,), by: Sequence[str] = (), drop_missing: bool = False) -> DataFrame:
    cols = value_columns(df, columns, by)
    return _added(df, {f"{c}_lag{k}": F.lag(c, k).over(ordered(by)) for c in cols for k in lags}, drop_missing)


def seasonal_lag(df: DataFrame, columns: Sequence[str] | None = None, season_length: int = 12, lags: Sequence[int] = (1,), by: Sequence[str] = (), drop_missing: bool = False) -> DataFrame:
    cols = value_columns(df, columns, by)
    return _added(df, {f"{c}_slag{k}": F.lag(c, k * season_length).over(ordered(by)) for c in cols for k in lags}, drop_missing)


def rolling_mean(df: DataFrame, columns: Sequence[str] | None = None, windows: Sequence[int] = (3,), min_periods: int | None = None, shift: int = 0, by: Sequence[str] = ()) -> DataFrame:
    cols = value_columns(df, columns, by)
    return _added(df, {f"{c}_mean{n}": full_mean(c, n, by, shift, min_periods) for c in cols for n in windows})


def moving_average_ladder(df: DataFrame, columns: Sequence[str] | None = None, max_window: int = 12, by: Sequence[str] = (), windows: Sequence[int] | None = None) -> DataFrame:
    return rolling_mean(df, columns, windows or range(1, max_window + 1), by=by)


def marx(df: DataFrame, columns: Sequence[str] | None = None, max_lag: int = 12, by: Sequence[str] = ()) -> DataFrame:
    """Means of lags 1..l for l = 1..max_lag; a missing lag makes the mean missing."""
    cols = value_columns(df, columns, by)
    return _added(df, {f"{c}_marx{n}": full_mean(c, n, by, shift=1) for c in cols for n in range(1, max_lag + 1)})


def transform_expr(c: str, transform: str, periods: int = 1, by: Sequence[str] = ()) -> Column:
    x, before = F.col(c), F.lag(c, periods).over(ordered(by))
    ln = lambda v: F.when(v > 0, F.ln(v))
    return {
        "log": ln(x), "diff": x - before, "log_diff": ln(x) - ln(before), "pct_change": ratio(x, before) - 1,
        "cumsum": F.when(x.isNotNull(), F.sum(c).over(upto(by))),
    }[transform]


def transform_features(df: DataFrame, transform: str, columns: Sequence[str] | None = None, periods: int = 1, by: Sequence[str] = (), drop_missing: bool = False) -> DataFrame:
    cols = value_columns(df, columns, by)
    return _added(df, {f"{c}_{transform}": transform_expr(c, transform, periods, by) for c in cols}, drop_missing)


def log_features(df: DataFrame, **options) -> DataFrame:
    return transform_features(df, "log", **options)


def diff_features(df: DataFrame, **options) -> DataFrame:
    return transform_features(df, "diff", **options)


def log_diff_features(df: DataFrame, **options) -> DataFrame:
    return transform_features(df, "log_diff", **options)


def pct_change_features(df: DataFrame, **options) -> DataFrame:
    return transform_features(df, "pct_change", **options)


def cumsum_features(df: DataFrame, **options) -> DataFrame:
    return transform_features(df, "cumsum", **options)


def moving_average_changes(df: DataFrame, columns: Sequence[str] | None = None, window: int = 3, method: str = "compound_percent", by: Sequence[str] = ()) -> DataFrame:
    """Change over the last ``window`` one-period changes; all of them must be observed."""
    out = {}
    for c in value_columns(df, columns, by):
        w = trailing(window, by)
        if method == "mean":
            value = F.avg(c).over(w)
        else:
            unit = 100.0 if method == "compound_percent" else 1.0
            value = (F.aggregate(F.collect_list(c).over(w), F.lit(1.0), lambda acc, x: acc * (1 + x / unit)) - 1) * unit
        out[f"{c}_change{window}"] = F.when(F.count(c).over(w) == window, value)
    return _added(df, out)


def rank_space_features(df: DataFrame, columns: Sequence[str] | None = None, prefix: str = "rank_", by: Sequence[str] = ()) -> DataFrame:
    """Each row's values in ascending order; a row with a missing value has none."""
    cols = value_columns(df, columns, by)
    held = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
    put = F.when(held, F.array_sort(F.array(*cols)))
    return _added(df, {f"{prefix}{i + 1}": put[i] for i in range(len(cols))})


asymmetric_trim_features = rank_space_features


def align_reference_weights(weights: Mapping[str, float], columns: Sequence[str], normalize: bool = True, fill_value: float = 0.0) -> dict[str, float]:
    held = {c: float(weights.get(c, fill_value)) for c in columns}
    total = sum(held.values())
    return {c: v / total for c, v in held.items()} if normalize and total else held


def weighted_aggregate(df: DataFrame, weights: Mapping[str, float], columns: Sequence[str] | None = None, normalize: bool = True, name: str = "weighted", by: Sequence[str] = ()) -> DataFrame:
    held = align_reference_weights(weights, value_columns(df, columns, by), normalize)
    return _added(df, {name: reduce(lambda a, b: a + b, [F.col(c) * F.lit(w) for c, w in held.items()])})


def fourier_features(df: DataFrame, period: float = 12, order: int = 2, prefix: str = "fourier", by: Sequence[str] = ()) -> DataFrame:
    t = F.row_number().over(ordered(by)) - 1
    new = {}
    for k in range(1, order + 1):
        new[f"{prefix}_sin{k}"] = F.sin(F.lit(2 * pi * k / period) * t)
        new[f"{prefix}_cos{k}"] = F.cos(F.lit(2 * pi * k / period) * t)
    return _added(df, new)


def season_dummy(df: DataFrame, frequency: str = "month", drop_first: bool = False) -> DataFrame:
    part, n = (F.month(DATE), 12) if frequency == "month" else (F.quarter(DATE), 4)
    return _added(df, {f"{frequency}_{i}": (part == i).cast("int") for i in range(2 if drop_first else 1, n + 1)})


def time_features(df: DataFrame, trend: bool = True, month: bool = False, quarter: bool = False, year: bool = False, by: Sequence[str] = ()) -> DataFrame:
    new = {"trend": F.row_number().over(ordered(by)), "month": F.month(DATE), "quarter": F.quarter(DATE), "year": F.year(DATE)}
    wanted = {"trend": trend, "month": month, "quarter": quarter, "year": year}
    return _added(df, {k: v for k, v in new.items() if wanted[k]})


def _product(cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a * b, [F.col(c) for c in cols])


def polynomial_features(df: DataFrame, columns: Sequence[str] | None = None, degree: int = 2, by: Sequence[str] = ()) -> DataFrame:
    cols = value_columns(df, columns, by)
    return _added(df, {"_x_".join(p): _product(p) for d in range(2, degree + 1) for p in combinations_with_replacement(cols, d)})


def interaction_features(df: DataFrame, columns: Sequence[str] | None = None, order: int = 2, by: Sequence[str] = ()) -> DataFrame:
    cols = value_columns(df, columns, by)
    return _added(df, {"_x_".join(p): _product(p) for d in range(2, order + 1) for p in combinations(cols, d)})


def scale_features(df: DataFrame, columns: Sequence[str] | None = None, method: str = "zscore", fit_policy: str = "expanding", by: Sequence[str] = ()) -> DataFrame:
    """Scaled by what was known at each row (``expanding``) or by the whole sample (``full``)."""
    w = upto(by) if fit_policy == "expanding" else whole(by)
    new = {}
    for c in value_columns(df, columns, by):
        if method == "zscore":
            a, s = F.avg(c).over(w), F.stddev_pop(c).over(w)
        elif method == "robust":
            q = F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(w)
            a, s = q[1], q[2] - q[0]
        else:
            a, s = F.min(c).over(w), F.max(c).over(w) - F.min(c).over(w)
        new[f"{c}_scaled"] = F.try_divide(F.col(c) - a, s)
    return _added(df, new)


def wavelet_features(df: DataFrame, columns: Sequence[str] | None = None, n_levels: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """Per level j the trailing mean of up to 2**j rows and what it leaves."""
    new = {}
    for c in value_columns(df, columns, by):
        for j in range(1, n_levels + 1):
            a = F.avg(c).over(trailing(2**j, by))
            new[f"{c}_wA{j}"], new[f"{c}_wD{j}"] = a, F.col(c) - a
    return _added(df, new)


def savitzky_golay_features(df: DataFrame, columns: Sequence[str] | None = None, window_length: int = 5, polyorder: int = 2, derivative: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """Centred polynomial smoother: interior rows by fixed weights, edge rows by the edge's own polynomial."""
    half = window_length // 2
    z = np.arange(-half, half + 1)
    powers = np.vander(z, polyorder + 1, increasing=True)
    fit = np.linalg.pinv(powers)

    def weights(at: int) -> list[float]:
        d = [0.0 if k < derivative else float(np.prod(range(k - derivative + 1, k + 1)) * at ** (k - derivative)) for k in range(polyorder + 1)]
        return [float(x) for x in np.array(d) @ fit]

    w = ordered(by)
    n, i = F.count(F.lit(1)).over(whole(by)), F.row_number().over(w)
    centre = F.least(F.greatest(i, F.lit(half + 1)), n - half)
    new = {}
    for c in value_columns(df, columns, by):
        span = F.collect_list(F.struct(F.col(c).alias("v"))).over(w.rowsBetween(-2 * half, 2 * half))
        first = F.least(i, F.lit(2 * half + 1))  # place of the row itself inside the span
        at = i - centre
        value = F.lit(None).cast("double")
        for k in range(-half, half + 1):
            terms = [F.get(span, first - 1 - at + j).getField("v") * F.lit(x) for j, x in zip(range(-half, half + 1), weights(k))]
            value = F.when(at == k, reduce(lambda a, b: a + b, terms)).otherwise(value)
        new[f"{c}_sg"] = F.when(n >= window_length, value)
    return _added(df, new)


def random_projection_features(df: DataFrame, columns: Sequence[str] | None = None, n_components: int = 2, random_state: int = 0, prefix: str = "rp", by: Sequence[str] = ()) -> DataFrame:
    cols = value_columns(df, columns, by)
    m = np.random.default_rng(random_state).normal(0, 1 / np.sqrt(n_components), (n_components, len(cols)))
    return _added(df, {f"{prefix}{k + 1}": reduce(lambda a, b: a + b, [F.col(c) * F.lit(float(x)) for c, x in zip(cols, m[k])]) for k in range(n_components)})


def mixed_frequency_lags(low: DataFrame, anchors: DataFrame, columns: Sequence[str], lags: Sequence[int] = (0, 1), unit: str = "quarter") -> DataFrame:
    """Each anchor date with the value of the period ``lag`` native periods back; a missing period gives NULL."""
    months = {"month": 1, "quarter": 3, "year": 12}[unit]
    src = low.select(F.trunc(DATE, unit).alias("_p"), *columns)
    out = anchors
    for k in lags:
        named = src.select(F.col("_p").alias(f"_p{k}"), *[F.col(c).alias(f"{c}_l{k}") for c in columns])
        out = out.withColumn(f"_p{k}", F.add_months(F.trunc(DATE, unit), -k * months)).join(named, f"_p{k}", "left").drop(f"_p{k}")
    return out


# Targets.


def _step_transform(c: str, transform: str, by: Sequence[str], ahead: int) -> Column:
    """One-period transform ``ahead`` rows from here."""
    w = ordered(by)
    now, before = F.lead(c, ahead).over(w), F.lead(c, ahead - 1).over(w)
    return {
        "level": now, "change": now - before, "growth": ratio(now, before) - 1,
        "log_growth": F.when((now > 0) & (before > 0), F.ln(now) - F.ln(before)),
    }[transform]


def direct_target(df: DataFrame, target: str, horizons: Sequence[int] = (1,), transform: str = "level", by: Sequence[str] = (), drop_missing: bool = False) -> DataFrame:
    """``y_h`` known ``h`` rows ahead: level, change, growth or log_growth since now, or an average_* of steps."""
    w, x, new = ordered(by), F.col(target), {}
    for h in horizons:
        y = F.lead(target, h).over(w)
        if transform.startswith("average_"):
            steps = [_step_transform(target, transform.removeprefix("average_"), by, s) for s in range(1, h + 1)]
            value = reduce(lambda a, b: a + b, steps) / h
        else:
            value = {
                "level": y, "change": y - x, "growth": ratio(y, x) - 1,
                "log_growth": F.when((y > 0) & (x > 0), F.ln(y) - F.ln(x)),
            }[transform]
        new[f"{target}_{transform}_h{h}"] = value
    return _added(df, new, drop_missing)


def average_target(df: DataFrame, target: str, horizons: Sequence[int] = (1,), transform: str = "change", **options) -> DataFrame:
    return direct_target(df, target, horizons, f"average_{transform}", **options)


def forward_average_target(df: DataFrame, target: str, horizons: Sequence[int] = (1,), by: Sequence[str] = ()) -> DataFrame:
    new = {}
    for h in horizons:
        w = ordered(by).rowsBetween(1, h)
        new[f"{target}_fwd{h}"] = F.when(F.count(target).over(w) == h, F.avg(target).over(w))
    return _added(df, new)


def path_targets(df: DataFrame, target: str, horizon: int, transform: str = "change", by: Sequence[str] = ()) -> DataFrame:
    return _added(df, {f"{target}_step{s}": _step_transform(target, transform, by, s) for s in range(1, horizon + 1)})


# Selection.


def _top(scores: DataFrame, n_features: float, total: int) -> DataFrame:
    k = max(1, int(n_features * total)) if isinstance(n_features, float) and n_features <= 1 else int(n_features)
    return scores.orderBy(F.col("score").desc_nulls_last(), "feature").limit(k)


def variance_selection(df: DataFrame, columns: Sequence[str] | None = None, n_features: float = 0.5) -> DataFrame:
    """feature, score: the columns of largest sample variance."""
    cols = value_columns(df, columns)
    one = df.agg(*[F.var_samp(c).alias(c) for c in cols])
    return _top(one.unpivot([], cols, "feature", "score"), n_features, len(cols))


def correlation_selection(df: DataFrame, target: str, columns: Sequence[str] | None = None, n_features: float = 0.5) -> DataFrame:
    """feature, score: the columns of largest absolute correlation with the target on complete rows."""
    cols = [c for c in value_columns(df, columns) if c != target]
    whole_rows = df.dropna("any", subset=[*cols, target])
    one = whole_rows.agg(*[F.abs(F.corr(c, target)).alias(c) for c in cols])
    return _top(one.unpivot([], cols, "feature", "score"), n_features, len(cols))


def marginal_t_stats(df: DataFrame, target: str, columns: Sequence[str] | None = None) -> DataFrame:
    """feature, t_stat: slope t of the target on each column alone, with an intercept; a tiny standard error gives 0."""
    cols = [c for c in value_columns(df, columns) if c != target]
    long = melt(df, cols, [target], "feature", "x").where(F.col("x").isNotNull() & F.col(target).isNotNull())
    g = long.groupBy("feature").agg(
        F.regr_slope(target, "x").alias("b"), F.regr_sxx(target, "x").alias("sxx"), F.regr_syy(target, "x").alias("syy"),
        F.regr_sxy(target, "x").alias("sxy"), F.count(F.lit(1)).alias("n"),
    )
    se = F.sqrt(F.greatest(F.col("syy") - F.col("b") * F.col("sxy"), F.lit(0.0)) / (F.col("n") - 2) / F.col("sxx"))
    return g.where("n > 2 AND sxx > 0").select("feature", F.when(se < 1e-12, 0.0).otherwise(F.col("b") / se).alias("t_stat"))


def fit_predictor_screen(df: DataFrame, target: str, columns: Sequence[str] | None = None, threshold: float = 1.28, top_k: int | None = None) -> DataFrame:
    kept = marginal_t_stats(df, target, columns).where(F.abs("t_stat") >= threshold)
    return kept.orderBy(F.abs("t_stat").desc(), "feature").limit(top_k) if top_k else kept


predictor_screen = fit_predictor_screen

Step = Callable[[DataFrame], DataFrame]


def compose_features(df: DataFrame, steps: Sequence[Step], drop_missing: bool = False) -> DataFrame:
    """Steps in order, each on what the earlier ones made."""
    out = reduce(lambda d, s: d.transform(s), steps, df)
    return out.dropna("any") if drop_missing else out


def step(func: Callable[..., DataFrame], **options) -> Step:
    """A feature function with its options, to be composed."""
    return lambda df: func(df, **options)


lag_step = lambda **o: step(lag, **o)
rolling_step = lambda **o: step(rolling_mean, **o)
moving_average_step = lambda **o: step(moving_average_ladder, **o)
marx_step = lambda **o: step(marx, **o)
transform_step = lambda **o: step(transform_features, **o)
seasonal_lag_step = lambda **o: step(seasonal_lag, **o)
season_dummy_step = lambda **o: step(season_dummy, **o)
fourier_step = lambda **o: step(fourier_features, **o)
time_step = lambda **o: step(time_features, **o)
polynomial_step = lambda **o: step(polynomial_features, **o)
interaction_step = lambda **o: step(interaction_features, **o)
scale_step = lambda **o: step(scale_features, **o)
random_projection_step = lambda **o: step(random_projection_features, **o)
custom_step = step


def custom_features(df: DataFrame, func: Callable[..., DataFrame], **params) -> DataFrame:
    return func(df, **params)


def build_features(df: DataFrame, target: str, horizon: int = 1, lags: Sequence[int] = (1,), windows: Sequence[int] = (3,), by: Sequence[str] = ()) -> DataFrame:
    """Lags and rolling means of all columns and the direct target, complete rows only."""
    cols = value_columns(df, None, by)
    made = rolling_mean(lag(df, cols, lags, by), cols, windows, by=by)
    return direct_target(made, target, (horizon,), by=by).dropna("any")
