"""Forecast combination in long form: one row per target, horizon, date and model."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._base import ratio

KEYS = ["target", "horizon"]
AT = [*KEYS, "date"]


def _rows(forecasts: DataFrame) -> DataFrame:
    return forecasts.where("prediction IS NOT NULL")


def _made(forecasts: DataFrame, value: Column, name: str) -> DataFrame:
    return _rows(forecasts).groupBy(*AT).agg(F.max("actual").alias("actual"), value.alias("prediction")).withColumn("model", F.lit(name))


def combine_mean(forecasts: DataFrame, name: str = "comb_mean") -> DataFrame:
    return _made(forecasts, F.avg("prediction"), name)


def combine_median(forecasts: DataFrame, name: str = "comb_median") -> DataFrame:
    return _made(forecasts, F.median("prediction"), name)


def combine_trimmed_mean(forecasts: DataFrame, trim: float = 0.1, name: str = "comb_trimmed") -> DataFrame:
    """Without the floor(trim * M) smallest and largest."""
    g = _rows(forecasts).groupBy(*AT).agg(F.max("actual").alias("actual"), F.array_sort(F.collect_list("prediction")).alias("p"))
    cut = F.floor(F.size("p") * F.lit(trim)).cast("int")
    kept = F.slice("p", cut + 1, F.size("p") - 2 * cut)
    return g.select(*AT, "actual", (F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.size(kept)).alias("prediction"), F.lit(name).alias("model"))


def combine_winsorized_mean(forecasts: DataFrame, limits: tuple[float, float] = (0.1, 0.1), name: str = "comb_winsorized") -> DataFrame:
    at = Window.partitionBy(*AT)
    lo, hi = F.percentile("prediction", F.lit(limits[0])).over(at), F.percentile("prediction", F.lit(1 - limits[1])).over(at)
    return combine_mean(_rows(forecasts).withColumn("prediction", F.least(F.greatest("prediction", lo), hi)), name)


def _history(horizon_rows: int) -> Window:
    return Window.partitionBy(*KEYS, "model").orderBy("date").rowsBetween(Window.unboundedPreceding, -horizon_rows)


def _lagged_loss(forecasts: DataFrame, how: Callable[[Column], Column], horizon: int) -> DataFrame:
    """Every (date, model) with its loss history up to ``horizon`` dates before; a model missing at a date keeps its history."""
    grid = forecasts.select(*AT, "actual").groupBy(*AT).agg(F.max("actual").alias("actual"))
    models = forecasts.select(*KEYS, "model").distinct()
    full = grid.join(models, KEYS).join(forecasts.select(*AT, "model", "prediction"), [*AT, "model"], "left")
    e2 = F.pow(F.col("actual") - F.col("prediction"), 2)
    return full.withColumn("_h", how(e2).over(_history(horizon)))


def combine_inverse_mspe(forecasts: DataFrame, discount: float = 1.0, min_weight: float = 1e-12, horizon: int = 1, name: str = "comb_inverse_mspe") -> DataFrame:
    """Weights 1 / (discounted) mean squared errors known ``horizon`` dates before; equal until all have a history."""
    if discount == 1.0:
        rows = _lagged_loss(forecasts, F.sum, horizon)
    else:
        rows = _lagged_loss(forecasts, F.collect_list, horizon)
        rows = rows.withColumn("_h", F.when(F.size("_h") > 0, F.aggregate("_h", F.lit(0.0), lambda a, x: a * discount + x)))
    rows = rows.where("prediction IS NOT NULL")
    at = Window.partitionBy(*AT)
    ready = F.min(F.col("_h").isNotNull()).over(at)
    weight = F.when(ready, 1 / F.greatest(F.col("_h"), F.lit(min_weight))).otherwise(1.0)
    g = rows.withColumn("_w", weight).groupBy(*AT)
    return g.agg(F.max("actual").alias("actual"), (F.sum(F.col("_w") * F.col("prediction")) / F.sum("_w")).alias("prediction")).withColumn("model", F.lit(name))


def combine_best_n(forecasts: DataFrame, n: int = 3, horizon: int = 1, name: str = "comb_best_n") -> DataFrame:
    """Mean of the ``n`` models of least mean squared error known ``horizon`` dates before; of all without a history."""
    rows = _lagged_loss(forecasts, F.avg, horizon).where("prediction IS NOT NULL")
    at = Window.partitionBy(*AT)
    rank = F.row_number().over(at.orderBy(F.col("_h").asc_nulls_last(), "model"))
    rows = rows.withColumn("_r", rank).withColumn("_any", F.max(F.col("_h").isNotNull()).over(at))
    return _made(rows.where(~F.col("_any") | (F.col("_r") <= n)), F.avg("prediction"), name)


def combine_linear_pool(densities: DataFrame, mean: str = "prediction", variance: str = "variance_prediction") -> DataFrame:
    """Equal-weight Gaussian mixture: its mean and variance."""
    m, v = F.avg(mean), F.avg(F.col(variance) + F.pow(mean, 2))
    return densities.groupBy(*AT).agg(m.alias("prediction"), (v - m * m).alias("variance_prediction"))


def combine_log_pool(densities: DataFrame, mean: str = "prediction", variance: str = "variance_prediction") -> DataFrame:
    """Equal-weight logarithmic pool: precision-weighted Gaussian."""
    precision = F.avg(1 / F.col(variance))
    return densities.groupBy(*AT).agg(ratio(F.avg(F.col(mean) / F.col(variance)), precision).alias("prediction"), ratio(F.lit(1.0), precision).alias("variance_prediction"))


# Recursive weights: one NumPy kernel per target and horizon.


def _simplex(v: np.ndarray) -> np.ndarray:
    u = np.sort(v)[::-1]
    k = np.arange(1, len(v) + 1)
    cut = (np.cumsum(u) - 1) / k
    return np.maximum(v - cut[np.flatnonzero(u > cut)[-1]], 0)


def constrained_ls_weights(f: np.ndarray, y: np.ndarray, steps: int = 500) -> np.ndarray:
    """Least squares on the simplex by accelerated projected gradient."""
    g, b = f.T @ f, f.T @ y
    size = max(np.linalg.eigvalsh(g)[-1], 1e-300)
    w = z = np.full(f.shape[1], 1 / f.shape[1])
    t = 1.0
    for _ in range(steps):
        new = _simplex(z - (g @ z - b) / size)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w, z, t = new, new + (t - 1) / t2 * (new - w), t2
    return w


def min_variance_weights(errors: np.ndarray) -> np.ndarray:
    w = np.linalg.pinv(errors.T @ errors / len(errors)) @ np.ones(errors.shape[1])
    return w / w.sum() if abs(w.sum()) > 1e-12 else np.full(len(w), 1 / len(w))


def regression_weights(f: np.ndarray, y: np.ndarray, intercept: bool = True, sum_to_one: bool = False) -> tuple[float, np.ndarray]:
    if sum_to_one:
        d = f[:, :-1] - f[:, -1:]
        w = np.linalg.lstsq(d, y - f[:, -1], rcond=None)[0]
        return 0.0, np.append(w, 1 - w.sum())
    x = np.column_stack([np.ones(len(f)), f]) if intercept else f
    w = np.linalg.lstsq(x, y, rcond=None)[0]
    return (float(w[0]), w[1:]) if intercept else (0.0, w)


def eigenvector_weights(errors: np.ndarray) -> np.ndarray:
    v = np.linalg.eigh(errors.T @ errors / len(errors))[1][:, 0]
    return v / v.sum() if abs(v.sum()) > 1e-12 else np.full(len(v), 1 / len(v))


def regularized_weights(f: np.ndarray, y: np.ndarray, alpha: float = 1.0) -> tuple[float, np.ndarray]:
    fm, ym = f.mean(0), y.mean()
    w = np.linalg.solve((f - fm).T @ (f - fm) + alpha * np.eye(f.shape[1]), (f - fm).T @ (y - ym))
    return float(ym - fm @ w), w


def shrink_weights(w: np.ndarray, shrinkage: float) -> np.ndarray:
    return shrinkage / len(w) + (1 - shrinkage) * w


_RECURSIVE: dict[str, Callable[[np.ndarray, np.ndarray], tuple[float, np.ndarray]]] = {
    "bates_granger": lambda f, y: (0.0, min_variance_weights(y[:, None] - f)),
    "granger_ramanathan": lambda f, y: regression_weights(f, y, True),
    "constrained_ls": lambda f, y: (0.0, constrained_ls_weights(f, y)),
    "eigenvector": lambda f, y: (0.0, eigenvector_weights(y[:, None] - f)),
    "regularized": lambda f, y: regularized_weights(f, y),
}


def combine_recursive(
    forecasts: DataFrame, method: str, horizon: int = 1, min_periods: int = 10, window: int | None = None,
    shrink_to_equal: float = 0.0, name: str | None = None,
) -> DataFrame:
    """Weights from complete rows known ``horizon`` dates before; the mean of what is there until ``min_periods``."""
    label = name or f"comb_{method}"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="date", columns="model", values="prediction").sort_index()
        y = pdf.groupby("date")["actual"].max().reindex(wide.index)
        f, full, out = wide.to_numpy(), (wide.notna().all(axis=1) & y.notna()).to_numpy(), []
        for t in range(len(wide)):
            past = np.flatnonzero(full[: max(0, t - horizon + 1)])
            past = past[-window:] if window else past
            if len(past) >= min_periods and full_row(f[t]):
                a, w = _RECURSIVE[method](f[past], y.to_numpy()[past])
                w = shrink_weights(w, shrink_to_equal) if shrink_to_equal else w
                out.append(a + f[t] @ w)
            else:
                out.append(np.nanmean(f[t]))
        return pd.DataFrame({"target": pdf["target"].iloc[0], "horizon": pdf["horizon"].iloc[0], "date": wide.index, "actual": y.to_numpy(), "prediction": out, "model": label})

    kind = {f.name: f.dataType.simpleString() for f in forecasts.schema}
    return _rows(forecasts).select(*AT, "model", "actual", "prediction").groupBy(*KEYS).applyInPandas(
        one, f"target {kind['target']}, horizon {kind['horizon']}, date {kind['date']}, actual double, prediction double, model string"
    )


def full_row(x: np.ndarray) -> bool:
    return bool(np.isfinite(x).all())


def combine_bates_granger(forecasts: DataFrame, **o) -> DataFrame:
    return combine_recursive(forecasts, "bates_granger", **o)


def combine_granger_ramanathan(forecasts: DataFrame, **o) -> DataFrame:
    return combine_recursive(forecasts, "granger_ramanathan", **o)


def combine_constrained_ls(forecasts: DataFrame, **o) -> DataFrame:
    return combine_recursive(forecasts, "constrained_ls", **o)


def combine_eigenvector(forecasts: DataFrame, **o) -> DataFrame:
    return combine_recursive(forecasts, "eigenvector", **o)


def combine_regularized(forecasts: DataFrame, **o) -> DataFrame:
    return combine_recursive(forecasts, "regularized", **o)


METHODS: dict[str, Callable[..., DataFrame]] = {
    "mean": combine_mean, "median": combine_median, "trimmed_mean": combine_trimmed_mean, "winsorized_mean": combine_winsorized_mean,
    "inverse_mspe": combine_inverse_mspe, "dmspe": lambda f, **o: combine_inverse_mspe(f, **{"discount": 0.9, **o}), "best_n": combine_best_n,
    "bates_granger": combine_bates_granger, "granger_ramanathan": combine_granger_ramanathan, "constrained_ls": combine_constrained_ls,
    "eigenvector": combine_eigenvector, "regularized": combine_regularized,
}


def custom_combination(forecasts: DataFrame, func: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return func(forecasts)


def apply_combinations(forecasts: DataFrame, methods: Sequence[str]) -> DataFrame:
    """``forecasts`` with combined rows of each method; combined rows already there are replaced."""
    single = forecasts.where(~F.col("model").startswith("comb_"))
    out = single.select(*AT, "actual", "prediction", "model")
    for m in methods:
        out = out.unionByName(METHODS[m](single).select(*AT, "actual", "prediction", "model"))
    return out
