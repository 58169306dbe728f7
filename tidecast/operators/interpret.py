"""Interpretation of fitted models: contributions, effects, importance and weights."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations
from math import factorial

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._base import ratio, upto
from .kernels import Predictor


def linear_coefficients(spark, names: Sequence[str], model: Predictor) -> DataFrame:
    return spark.createDataFrame([(n, float(b)) for n, b in zip(names, model.coef)], "feature string, coefficient double").orderBy(F.abs("coefficient").desc())


def shap_linear(frame: DataFrame, coefficients: Mapping[str, float], key: str = "date") -> DataFrame:
    """key, feature, shap = b (x - mean x)."""
    cols = list(coefficients)
    b = F.create_map(*[F.lit(v) for c in cols for v in (c, float(coefficients[c]))])
    long = frame.unpivot([key], cols, "feature", "x")
    return long.withColumn("shap", b[F.col("feature")] * (F.col("x") - F.avg("x").over(Window.partitionBy("feature")))).select(key, "feature", "shap")


def shapley_variable_importance(contributions: DataFrame, value: str = "shap", by: Sequence[str] = ("feature",)) -> DataFrame:
    return contributions.groupBy(*by).agg(F.avg(F.abs(value)).alias("importance"))


shap_importance = ishapley_vi = shapley_variable_importance


def forecast_decomposition(frame: DataFrame, coefficients: Mapping[str, float], key: str = "date") -> DataFrame:
    b = F.create_map(*[F.lit(v) for c, v in coefficients.items() for v in (c, float(v))])
    return frame.unpivot([key], list(coefficients), "feature", "x").select(key, "feature", (b[F.col("feature")] * F.col("x")).alias("contribution"))


def group_aggregate(table: DataFrame, groups: Mapping[str, str], value: str = "shap", by: Sequence[str] = ()) -> DataFrame:
    """Sum by group of features; features of no group are ``other``."""
    named = F.create_map(*[F.lit(v) for kv in groups.items() for v in kv])
    return table.withColumn("group", F.coalesce(named[F.col("feature")], F.lit("other"))).groupBy(*by, "group").agg(F.sum(value).alias(value))


def observation_contributions(weights: DataFrame, y_train: DataFrame) -> DataFrame:
    """weights (date, source_date, weight) times y_train (source_date, y)."""
    return weights.join(y_train, "source_date").withColumn("contribution", F.col("weight") * F.col("y"))


outcome_contributions = observation_contributions


def top_observations(weights: DataFrame, n: int = 10) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("date").orderBy(F.abs("weight").desc(), "source_date"))
    return weights.withColumn("rank", rank).where(F.col("rank") <= n)


top_episodes = top_observations


def data_portfolio_diagnostics(weights: DataFrame) -> DataFrame:
    """Concentration, leverage, short share and turnover of observation weights per date."""
    w = F.col("weight")
    g = weights.groupBy("date").agg(
        F.sum(w * w).alias("hhi"), F.sum(F.abs(w)).alias("leverage"), F.sum(F.when(w < 0, -w).otherwise(0.0)).alias("short"), F.sum(w).alias("total")
    )
    before = Window.partitionBy("source_date").orderBy("date")
    t = weights.withColumn("_d", F.abs(w - F.lag("weight").over(before))).groupBy("date").agg(F.sum("_d").alias("turnover"))
    return g.join(t, "date")


forecast_diagnostics = data_portfolio_diagnostics


def accumulated_local_effect(rows: DataFrame, feature: str, effect: str, bins: int = 10) -> DataFrame:
    """Bin, count, centred cumulative mean of local differences (a column) over quantile bins of a feature."""
    # Edges are one row of quantiles; rows find their bin by them, without being sorted in one task.
    cuts = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    edges = rows.agg(F.percentile(feature, cuts).alias("e")).scalar()
    above = [F.when(F.col(feature) > edges[i], 1).otherwise(0) for i in range(bins - 1)]
    b = rows.withColumn("bin", reduce(lambda n, x: n + x, above, F.lit(1)))
    g = b.groupBy("bin").agg(F.avg(effect).alias("local"), F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumn("ale", F.sum("local").over(w))
    all_bins = Window.partitionBy()
    return g.withColumn("ale", F.col("ale") - F.sum(F.col("ale") * F.col("n")).over(all_bins) / F.sum("n").over(all_bins))


def partial_dependence(model: Predictor, x: np.ndarray, feature: int, grid_size: int = 20) -> tuple[np.ndarray, np.ndarray]:
    g = np.unique(np.quantile(x[:, feature], np.linspace(0, 1, grid_size)))
    out = []
    for v in g:
        z = x.copy()
        z[:, feature] = v
        out.append(model(z).mean())
    return g, np.array(out)


def ice_curves(model: Predictor, x: np.ndarray, feature: int, grid_size: int = 20) -> tuple[np.ndarray, np.ndarray]:
    g = np.unique(np.quantile(x[:, feature], np.linspace(0, 1, grid_size)))
    z = np.repeat(x[None], len(g), 0)
    z[:, :, feature] = g[:, None]
    return g, np.array([model(v) for v in z]).T


def friedman_h(model: Predictor, x: np.ndarray, a: int, b: int) -> float:
    def pd(cols):
        out = np.zeros(len(x))
        for i in range(len(x)):
            z = x.copy()
            z[:, cols] = x[i, cols]
            out[i] = model(z).mean()
        return out - out.mean()

    both, one, two = pd([a, b]), pd([a]), pd([b])
    return float(((both - one - two) ** 2).sum() / max((both**2).sum(), 1e-300))


def permutation_importance(model: Predictor, x: np.ndarray, y: np.ndarray, n_repeats: int = 5, random_state: int = 0, bins: int | None = None) -> np.ndarray:
    """Mean loss increase per column; with ``bins`` shuffled inside quantile bins of the next column."""
    rng, base, out = np.random.default_rng(random_state), ((model(x) - y) ** 2).mean(), np.zeros(x.shape[1])
    for j in range(x.shape[1]):
        for _ in range(n_repeats):
            z = x.copy()
            if bins:
                c = x[:, (j + 1) % x.shape[1]]
                part = np.searchsorted(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1]), c)
                for k in range(bins):
                    ids = np.flatnonzero(part == k)
                    z[ids, j] = x[rng.permutation(ids), j]
            else:
                z[:, j] = x[rng.permutation(len(x)), j]
            out[j] += (((model(z) - y) ** 2).mean() - base) / n_repeats
    return out


def exact_shapley(value, players: int) -> np.ndarray:
    """Shapley values of ``value(frozenset)`` for up to eight players."""
    if players > 8:
        raise ValueError("at most eight players; use permutation_shapley")
    out = np.zeros(players)
    for i in range(players):
        rest = [j for j in range(players) if j != i]
        for k in range(players):
            for s in combinations(rest, k):
                w = factorial(k) * factorial(players - k - 1) / factorial(players)
                out[i] += w * (value(frozenset((*s, i))) - value(frozenset(s)))
    return out


def permutation_shapley(value, players: int, n: int = 200, random_state: int = 0) -> np.ndarray:
    rng, out = np.random.default_rng(random_state), np.zeros(players)
    for _ in range(n):
        seen: frozenset = frozenset()
        before = value(seen)
        for i in rng.permutation(players):
            seen = seen | {int(i)}
            now = value(seen)
            out[i] += (now - before) / n
            before = now
    return out


def ols_attention_weights(x_train: np.ndarray, x_test: np.ndarray, ridge: float = 0.0) -> np.ndarray:
    """Rows of X_test (X'X + ridge I)^-1 X' with an intercept: predictions are these weights times y_train."""
    a, b = (np.column_stack([np.ones(len(x)), x]) for x in (x_train, x_test))
    g = a.T @ a + ridge * np.diag([0.0, *np.ones(x_train.shape[1])])
    return b @ np.linalg.solve(g, a.T)


attention_weights = dual_decomposition = ols_attention_weights


def cumulative_r2(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    from .kernels import ols

    sst = ((y - y.mean()) ** 2).sum()
    r2 = [1 - ((y - ols(x[:, : k + 1], y)(x[:, : k + 1])) ** 2).sum() / sst for k in range(x.shape[1])]
    return np.diff([0.0, *r2])


def concentration(importance: DataFrame, value: str = "importance") -> DataFrame:
    share = F.col(value) / F.sum(value).over(Window.partitionBy())  # one row per feature
    return importance.withColumn("share", share).withColumn("cumulative", F.sum("share").over(upto((), value)))


def model_accordance(a: DataFrame, b: DataFrame) -> DataFrame:
    """Correlation of two importance tables (feature, importance)."""
    j = a.select("feature", F.col("importance").alias("x")).join(b.select("feature", F.col("importance").alias("y")), "feature")
    return j.agg(F.corr("x", "y").alias("accordance"), ratio(F.sum(F.col("x") * F.col("y")), F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("y") * F.col("y")))).alias("cosine"))
