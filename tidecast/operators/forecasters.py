"""Forecasters that are window expressions: every origin and series in one pass, no Python.

A forecast for ``date`` with horizon h uses rows up to h dates before it only.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import DATE, ordered, ratio, trailing, upto

Forecaster = Callable[[str, int, Sequence[str]], Column]


def naive(y: str, h: int, by: Sequence[str]) -> Column:
    """Last observed value."""
    return F.last(y, True).over(upto(by, lag=h))


def seasonal_naive(y: str, h: int, by: Sequence[str], period: int = 12) -> Column:
    """Last value of the same season that is known."""
    return F.lag(y, period * -(-h // period)).over(ordered(by))


def hist_mean(y: str, h: int, by: Sequence[str], window: int | None = None) -> Column:
    return F.avg(y).over(trailing(window, by, shift=h) if window else upto(by, lag=h))


def random_walk_drift(y: str, h: int, by: Sequence[str]) -> Column:
    """Last value and h times the mean step."""
    w = upto(by, lag=h)
    last, first, n = F.last(y, True).over(w), F.first(y, True).over(w), F.count(y).over(w)
    return last + h * ratio(last - first, n - 1)


def rolling_mean(y: str, h: int, by: Sequence[str], window: int = 3) -> Column:
    w = trailing(window, by, shift=h)
    return F.when(F.count(y).over(w) == window, F.avg(y).over(w))


DEFAULT: Mapping[str, Forecaster] = {
    "naive": naive, "seasonal_naive": seasonal_naive, "hist_mean": hist_mean, "drift": random_walk_drift, "ma3": rolling_mean,
}


def ar1_direct(panel: DataFrame, y: str, h: int, by: Sequence[str], name: str = "ar1", min_train: int = 24) -> DataFrame:
    """Direct regression of y on y[-h], refitted at every date on pairs whose target is known h dates before."""
    w = ordered(by)
    p = panel.withColumn("_x", F.lag(y, h).over(w))
    pair = F.col(y).isNotNull() & F.col("_x").isNotNull()
    p = p.withColumns({"_py": F.when(pair, F.col(y)), "_px": F.when(pair, F.col("_x"))})
    past = upto(by, lag=h)
    a, b = F.regr_intercept("_py", "_px").over(past), F.regr_slope("_py", "_px").over(past)
    return p.withColumn(name, F.when(F.count("_px").over(past) >= min_train, a + b * F.col("_x"))).drop("_x", "_px", "_py")


def window_forecasts(
    long: DataFrame, horizons: Sequence[int] = (1, 3), models: Mapping[str, Forecaster] = DEFAULT, ar1: bool = True,
    key: str = "target", y: str = "y", min_train: int = 24,
) -> DataFrame:
    """target, horizon, origin, origin_pos, date, model, prediction, actual from a long panel (target, date, y)."""
    by, parts = [key], []
    pos = F.row_number().over(ordered(by)) - 1
    for h in horizons:
        p = long.withColumns({name: f(y, h, by) for name, f in models.items()})
        names = list(models)
        if ar1:
            p, names = ar1_direct(p, y, h, by, min_train=min_train), [*names, "ar1"]
        p = p.withColumns({"origin": F.lag(DATE, h).over(ordered(by)), "origin_pos": (pos - h).cast("int")}).where(F.col("origin_pos") >= min_train)
        parts.append(
            p.withColumn("horizon", F.lit(h)).unpivot([key, "horizon", "origin", "origin_pos", DATE, y], names, "model", "prediction")
            .withColumnRenamed(y, "actual")
        )
    out = reduce(DataFrame.unionByName, parts)
    return out.select(F.col(key).alias("target"), "horizon", "origin", "origin_pos", DATE, "model", "prediction", "actual")
