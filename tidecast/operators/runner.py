"""A study as one grouped job: target x arm x chunk of origins.

A group holds one series and works through a chunk of origins and all horizons, so
a series is shuffled a few times per arm and not once per origin.  A row at position p
may train an h-step model at origin o only if its target is known: p <= o - h.
A fit that fails gives rows with ``error`` set, not a failed job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import econometrics, learners, networks, select, structural  # noqa: F401  they add models to the registry
from .kernels import get_model

SCHEMA = (
    "target string, horizon int, origin date, origin_pos int, date date, arm string, model string, prediction double, "
    "actual double, forecast_policy string, error string"
)


@dataclass(frozen=True)
class Arm:
    """One contender: a model, its parameters and how it reaches horizon h."""

    name: str
    model: str
    params: Mapping[str, object] = field(default_factory=dict)
    policy: str = "direct"  # direct, direct_average, recursive, path_average
    lags: int = 3


def model_arms(models: Sequence[str], **options) -> list[Arm]:
    return [Arm(m, m, **options) for m in models]


def _design(y: np.ndarray, x: np.ndarray | None, lags: int) -> np.ndarray:
    """Row t: y[t], ..., y[t - lags + 1] and the predictors of t."""
    own = np.column_stack([np.concatenate([np.full(k, np.nan), y[: len(y) - k]]) for k in range(lags)])
    return own if x is None or not x.shape[1] else np.column_stack([own, x])


def _direct(spec, params, z, y, o, s, fit_from):
    rows = np.arange(fit_from, o - s + 1)
    xs, ys = z[rows], y[rows + s]
    ok = np.isfinite(xs).all(1) & np.isfinite(ys)
    if ok.sum() < 5:
        raise ValueError("too few complete rows")
    return float(spec.fit(xs[ok], ys[ok], **params)(z[o][None])[0])


def forecast_origin(arm: Arm, y: np.ndarray, x: np.ndarray | None, o: int, h: int, fit_from: int = 0) -> float:
    """Forecast of y[o + h] with what is known at o."""
    spec, params = get_model(arm.model), dict(arm.params)
    if spec.kind == "target":
        past = y[fit_from : o + 1]
        past = past[np.isfinite(past)]
        return float(spec.fit(past, h, **params)[-1])
    if arm.policy == "recursive":
        path = y[: o + 1].copy()
        z = _design(path, None, arm.lags)
        rows = np.arange(fit_from, o)
        ok = np.isfinite(z[rows]).all(1) & np.isfinite(path[rows + 1])
        f = spec.fit(z[rows][ok], path[rows + 1][ok], **params)
        for _ in range(h):
            path = np.append(path, f(path[: -arm.lags - 1 : -1][None])[0])
        return float(path[-1])
    z = _design(y, x, arm.lags)
    if arm.policy == "direct_average":
        mean = np.full(len(y), np.nan)  # of the h values after each row, kept where the last of them is
        mean[h:] = np.lib.stride_tricks.sliding_window_view(y[1:], h).mean(1)
        return _direct(spec, params, z, mean, o, h, fit_from)
    if arm.policy == "path_average":
        return float(np.mean([_direct(spec, params, z, y, o, s, fit_from) for s in range(1, h + 1)]))
    return _direct(spec, params, z, y, o, h, fit_from)


def actual_of(arm: Arm, y: np.ndarray, o: int, h: int) -> float:
    """What a forecast is held against: the value h ahead, or for the averaging policies the mean of the h values."""
    return float(y[o + 1 : o + h + 1].mean()) if arm.policy in ("direct_average", "path_average") else float(y[o + h])


def run_arms(
    long: DataFrame, arms: Sequence[Arm], horizons: Sequence[int] = (1,), first_origin: int = 36, step: int = 1,
    window: int | None = None, predictors: Sequence[str] = (), chunk: int = 32,
) -> DataFrame:
    """Forecast table of all arms over a long panel (target, date, y, predictors).

    ``step`` is the distance of origins.  A chunk of origins gets the rows up to the last date it is scored on
    and, with a rolling ``window``, none from before its first one; all horizons share that copy.
    """
    spark, top = long.sparkSession, max(horizons)
    held, ahead = list(arms), sorted(set(horizons))
    reach = max((a.lags for a in held), default=1) - 1
    sizes = long.groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    cells = spark.createDataFrame([(i,) for i in range(len(held))], "cell int")
    chunks = F.explode(F.sequence(F.lit(0), F.greatest(F.floor((F.col("n") - first_origin) / (chunk * step)), F.lit(0)).cast("int"))).alias("chunk")
    tasks = sizes.where(F.col("n") > first_origin).select("target", "n", chunks).crossJoin(F.broadcast(cells))  # arms: the study's size
    start = first_origin + F.col("chunk") * chunk * step
    low = F.greatest(start + 1 - window - reach, F.lit(0)) if window else F.lit(0)
    tasks = tasks.select("target", "n", "cell", "chunk", low.alias("low"), (start + (chunk - 1) * step + top).alias("high"))
    placed = long.select("target", "date", "y", *predictors, (F.row_number().over(Window.partitionBy("target").orderBy("date")) - 1).alias("pos"))
    rows = placed.join(tasks, "target").where("pos BETWEEN low AND high")

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        y = pdf["y"].to_numpy(float)
        x = pdf[list(predictors)].to_numpy(float) if predictors else None
        arm, at, low, n = held[int(pdf["cell"].iloc[0])], int(pdf["chunk"].iloc[0]), int(pdf["low"].iloc[0]), int(pdf["n"].iloc[0])
        target, dates, out = pdf["target"].iloc[0], pdf["date"].to_numpy(), []
        for h in ahead:
            for o in range(first_origin + at * chunk * step, min(first_origin + (at + 1) * chunk * step, n - h), step):
                i = o - low
                try:
                    p, error = forecast_origin(arm, y, x, i, h, max(0, i + 1 - window) if window else 0), None
                except Exception as e:  # one fit must not end the study; the message is kept in its row
                    p, error = None, f"{type(e).__name__}: {e}"
                out.append((target, h, dates[i], o, dates[i + h], arm.name, arm.model, p, actual_of(arm, y, i, h), arm.policy, error))
        return pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return rows.groupBy("target", "cell", "chunk").applyInPandas(work, SCHEMA)


def run(long: DataFrame, model: str, horizon: int = 1, **options) -> DataFrame:
    return run_arms(long, [Arm(model, model)], (horizon,), **options)


def failed_cells(master: DataFrame) -> DataFrame:
    return master.where("error IS NOT NULL").groupBy("target", "arm", "horizon", "error").agg(F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class EvalSpec:
    benchmark: str
    metrics: tuple[str, ...] = ("mse", "rmse", "mae")
    combinations: tuple[str, ...] = ()
    adjust: str = "holm"


def evaluate(master: DataFrame, spec: EvalSpec) -> dict[str, DataFrame]:
    """accuracy, ranking, significance and confidence-set tables of a master table."""
    from . import combine, metrics, tests_stat

    f = master.where("error IS NULL").drop("model").withColumnRenamed("arm", "model")
    if spec.combinations:
        f = combine.apply_combinations(f, spec.combinations)
    accuracy = metrics.benchmark_comparison(f, spec.benchmark)
    return {
        "forecasts": f, "accuracy": accuracy, "ranking": metrics.rank_forecasts(accuracy, "rmse", ("target", "horizon")),
        "significance": tests_stat.adjust_pvalues(tests_stat.dm_test(f, spec.benchmark), spec.adjust),
        "mcs": tests_stat.model_confidence_set(f, n_boot=199),
    }


def run_pipeline(long: DataFrame, arms: Sequence[Arm], spec: EvalSpec, horizons: Sequence[int] = (1,), **options) -> dict[str, DataFrame]:
    master = run_arms(long, arms, horizons, **options).persist()
    return {"master": master, "failed": failed_cells(master), **evaluate(master, spec)}


# Search: candidates x folds, scored in one grouped job.


def grid(spark, params: Mapping[str, Sequence[float]]) -> DataFrame:
    """All combinations of the parameter values."""
    out = spark.range(1).select()
    for name, values in params.items():
        out = out.crossJoin(spark.createDataFrame([(float(v),) for v in values], f"{name} double"))
    return out.withColumn("trial", F.row_number().over(Window.orderBy(*params)) - 1)


def candidates(params: Mapping[str, Sequence], method: str = "grid", n_iter: int = 20, random_state: int = 0) -> list[dict]:
    from itertools import product

    whole = [dict(zip(params, v)) for v in product(*params.values())]
    if method == "grid" or len(whole) <= n_iter:
        return whole
    return [whole[i] for i in np.random.default_rng(random_state).choice(len(whole), n_iter, replace=False)]


def select_params(
    frame: DataFrame, model: str, x: Sequence[str], y: str, search: Sequence[Mapping[str, object]], folds: Sequence[tuple[int, int, int, int]],
) -> DataFrame:
    """trial, params, score (mean of the folds' mean squared errors), best; the first trial wins ties."""
    spark = frame.sparkSession
    held = [dict(s) for s in search]
    cells = spark.createDataFrame([(t, *f) for t in range(len(held)) for f in folds], "trial int, a int, b int, c int, d int")
    data = frame.select("date", *x, y).crossJoin(F.broadcast(cells))  # candidates x folds: the search's size
    spec = get_model(model)

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        t, a, b, c, d = (int(pdf[k].iloc[0]) for k in ("trial", "a", "b", "c", "d"))
        xs, ys = pdf[list(x)].to_numpy(float), pdf[y].to_numpy(float)
        f = spec.fit(xs[a:b], ys[a:b], **held[t])
        return pd.DataFrame({"trial": [t], "mse": [float(((f(xs[c:d]) - ys[c:d]) ** 2).mean())]})

    scored = data.groupBy("trial", "a", "b", "c", "d").applyInPandas(score, "trial int, mse double").groupBy("trial").agg(F.avg("mse").alias("score"))
    named = spark.createDataFrame([(i, {k: str(v) for k, v in p.items()}) for i, p in enumerate(held)], "trial int, params map<string,string>")
    rank = F.row_number().over(Window.orderBy("score", "trial"))
    return scored.join(named, "trial").withColumn("best", rank == 1)


# Ensembles: members are groups.


def ensemble(
    frame: DataFrame, model: str, x: Sequence[str], y: str, n_train: int, kind: str = "bagging", n_estimators: int = 20,
    max_samples: float = 0.8, max_features: float = 0.5, random_state: int = 0, **params,
) -> DataFrame:
    """date, prediction of the rows after the first ``n_train``: bagging, subagging or random_subspace of a base model."""
    members = frame.sparkSession.range(n_estimators).select(F.col("id").cast("int").alias("member"))
    data = frame.select("date", *x, y).crossJoin(F.broadcast(members))  # one copy per member: the ensemble's size
    spec = get_model(model)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        rng = np.random.default_rng([random_state, int(pdf["member"].iloc[0])])
        xs, ys = pdf[list(x)].to_numpy(float), pdf[y].to_numpy(float)
        cols = np.arange(len(x))
        k = max(2, int(max_samples * n_train))
        ids = rng.integers(0, n_train, k) if kind == "bagging" else rng.choice(n_train, k, replace=False)
        if kind == "random_subspace":
            cols, ids = np.sort(rng.choice(len(x), max(1, int(max_features * len(x))), replace=False)), np.arange(n_train)
        f = spec.fit(xs[ids][:, cols], ys[ids], **params)
        return pd.DataFrame({"date": pdf["date"].to_numpy()[n_train:], "prediction": f(xs[n_train:][:, cols])})

    return data.groupBy("member").applyInPandas(fit, "date date, prediction double").groupBy("date").agg(F.avg("prediction").alias("prediction"))


def bagging(frame, model="ridge", **o):
    return ensemble(frame, model, kind="bagging", **o)


def subagging(frame, model="ridge", max_samples=0.632, **o):
    return ensemble(frame, model, kind="subagging", max_samples=max_samples, **o)


def random_subspace(frame, model="ridge", **o):
    return ensemble(frame, model, kind="random_subspace", **o)


def super_learner(x: np.ndarray, y: np.ndarray, models: Sequence[str] = ("ridge", "pcr", "knn"), n_splits: int = 5):
    """Convex weights on forward out-of-fold predictions; returns (predictor, weights)."""
    from .combine import constrained_ls_weights

    cuts = [len(y) * i // (n_splits + 1) for i in range(1, n_splits + 2)]
    oof = np.vstack([np.column_stack([get_model(m).fit(x[:a], y[:a])(x[a:b]) for m in models]) for a, b in zip(cuts, cuts[1:])])
    w = constrained_ls_weights(oof, y[cuts[0] : cuts[-1]])
    fits = [get_model(m).fit(x, y) for m in models]
    return (lambda new: sum(wi * f(new) for wi, f in zip(w, fits))), w
