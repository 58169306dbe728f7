"""Interpretation that refits or differentiates models, and forecast anatomy: Shapley values of every forecast of a study.

Relational parts (attribution of losses, sums by lineage or episode) are closed
forms in DataFrame expressions; what calls a model runs inside grouped functions.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._base import ratio
from .interpret import exact_shapley, permutation_importance, permutation_shapley
from .kernels import Predictor, Tree, get_model
from .runner import Arm, _design

# Importance by refitting.


def lofo_importance(arm: Arm, x: np.ndarray, y: np.ndarray, n_train: int) -> np.ndarray:
    """Rise of the later rows' mean squared error when a column is left out and the model fitted again."""
    fit = get_model(arm.model).fit

    def loss(cols):
        return float(((fit(x[:n_train][:, cols], y[:n_train], **arm.params)(x[n_train:][:, cols]) - y[n_train:]) ** 2).mean())

    every = list(range(x.shape[1]))
    base = loss(every)
    return np.array([loss([c for c in every if c != j]) - base if len(every) > 1 else np.nan for j in every])


def lasso_inclusion_frequency(x: np.ndarray, y: np.ndarray, alpha: float = 0.01, n_bootstraps: int = 50, random_state: int = 0) -> np.ndarray:
    """Share of bootstrap samples in which a column's coefficient is not zero."""
    rng, hits, fit = np.random.default_rng(random_state), np.zeros(x.shape[1]), get_model("lasso").fit
    for _ in range(n_bootstraps):
        ids = rng.integers(0, len(y), len(y))
        hits += np.abs(fit(x[ids], y[ids], alpha=alpha).coef) > 1e-10
    return hits / n_bootstraps


def rolling_recompute(arm: Arm, x: np.ndarray, y: np.ndarray, window: int, step: int = 1, importance: Callable = permutation_importance) -> np.ndarray:
    """(window, column): an importance of the model refitted on rolling windows of rows."""
    out = []
    for a in range(0, len(y) - window + 1, step):
        xs, ys = x[a : a + window], y[a : a + window]
        out.append(importance(get_model(arm.model).fit(xs, ys, **arm.params), xs, ys))
    return np.array(out)


def bootstrap_jackknife(arm: Arm, x: np.ndarray, y: np.ndarray, n_replications: int = 50, random_state: int = 0, importance: Callable = permutation_importance) -> dict[str, np.ndarray]:
    """Mean and standard error of an importance over bootstrap refits, and its jackknife standard error over ten blocks."""
    rng, fit = np.random.default_rng(random_state), get_model(arm.model).fit
    boot = np.array([importance(fit(x[i], y[i], **arm.params), x, y) for i in (rng.integers(0, len(y), len(y)) for _ in range(n_replications))])
    parts = np.array_split(np.arange(len(y)), min(10, len(y)))
    jack = np.array([importance(fit(np.delete(x, p, 0), np.delete(y, p), **arm.params), x, y) for p in parts])
    k = len(parts)
    return {"mean": boot.mean(0), "se": boot.std(0, ddof=1), "jackknife_se": np.sqrt((k - 1) / k * ((jack - jack.mean(0)) ** 2).sum(0))}


def tree_importance(model: Predictor | Sequence[Tree], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Share of the squared error that each column's cuts take away, over all trees."""
    trees, out = [model] if isinstance(model, Tree) else list(model), np.zeros(x.shape[1])
    for t in trees:
        ids = {0: np.arange(len(y))}
        for node in range(len(t.feature)):  # children come after their parent
            own = ids.pop(node, np.zeros(0, int))
            if t.feature[node] < 0 or not len(own):
                continue
            low = x[own, t.feature[node]] <= t.cut[node]
            ids[t.left[node]], ids[t.right[node]] = own[low], own[~low]
            sse = lambda i: float(((y[i] - y[i].mean()) ** 2).sum()) if len(i) else 0.0
            out[t.feature[node]] += sse(own) - sse(own[low]) - sse(own[~low])
    return out / out.sum() if out.sum() > 0 else out


model_native_tree_importance = tree_importance


def model_native_linear_coef(model: Predictor) -> np.ndarray:
    if not hasattr(model, "coef"):
        raise TypeError("the model has no coefficients")
    return np.asarray(model.coef)


# Shapley values of predictions.


def shapley_rows(model: Predictor, x: np.ndarray, background: np.ndarray, n: int = 64, random_state: int = 0) -> tuple[np.ndarray, float]:
    """(row, column) contributions and the base value; up to eight columns exactly, else by permutations.

    Columns outside a coalition take the background rows' values, over which predictions are averaged.
    """
    base, out = float(model(background).mean()), np.zeros(x.shape)

    def value(row):
        seen: dict[frozenset, float] = {}

        def of(s: frozenset) -> float:
            if s not in seen:
                z = background.copy()
                z[:, list(s)] = row[list(s)]
                seen[s] = float(model(z).mean())
            return seen[s]

        return of

    for r in range(len(x)):
        v = value(x[r])
        out[r] = exact_shapley(v, x.shape[1]) if x.shape[1] <= 8 else permutation_shapley(v, x.shape[1], n, random_state)
    return out, base


def shap_tree(model: Predictor, x: np.ndarray, background: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    return shapley_rows(model, x, x if background is None else background)


def _gradient(model: Predictor, x: np.ndarray) -> np.ndarray:
    if hasattr(model, "gradient"):
        return model.gradient(x)
    if hasattr(model, "coef"):
        return np.tile(np.asarray(model.coef), (len(x), 1))
    step, out = 1e-4 * np.maximum(x.std(0), 1e-6), np.zeros(x.shape)
    for j in range(x.shape[1]):  # central differences
        up, down = x.copy(), x.copy()
        up[:, j] += step[j]
        down[:, j] -= step[j]
        out[:, j] = (model(up) - model(down)) / (2 * step[j])
    return out


def saliency_map(model: Predictor, x: np.ndarray) -> np.ndarray:
    return np.abs(_gradient(model, x))


def integrated_gradients(model: Predictor, x: np.ndarray, baseline: np.ndarray | None = None, n_steps: int = 50) -> np.ndarray:
    """Differences to the baseline times the mean gradient on the way; they sum to the change of the prediction."""
    b = np.zeros(x.shape[1]) if baseline is None else np.asarray(baseline, float)
    at = (np.arange(n_steps) + 0.5) / n_steps
    return (x - b) * np.mean([_gradient(model, b + t * (x - b)) for t in at], axis=0)


def gradient_shap(model: Predictor, x: np.ndarray, baseline: np.ndarray | None = None, n_samples: int = 20, noise_scale: float = 0.0, random_state: int = 0) -> np.ndarray:
    """Gradients at random points between noisy inputs and random baseline rows."""
    rng = np.random.default_rng(random_state)
    b = np.zeros((1, x.shape[1])) if baseline is None else np.atleast_2d(baseline)
    out = np.zeros(x.shape)
    for _ in range(n_samples):
        z, start = x + noise_scale * rng.normal(size=x.shape), b[rng.integers(0, len(b), len(x))]
        out += _gradient(model, start + rng.random((len(x), 1)) * (z - start)) * (z - start) / n_samples
    return out


def deep_lift(model: Predictor, x: np.ndarray, baseline: np.ndarray | None = None, n_steps: int = 200) -> np.ndarray:
    """Contributions of the differences to a reference, scaled per row to sum to the change of the prediction exactly."""
    b = np.zeros(x.shape[1]) if baseline is None else np.asarray(baseline, float)
    part = integrated_gradients(model, x, b, n_steps)
    change, total = model(x) - model(np.repeat(b[None], len(x), 0)), part.sum(1)
    return part * np.where(np.abs(total) > 1e-12, change / np.where(np.abs(total) > 1e-12, total, 1), 1.0)[:, None]


shap_deep = deep_lift
_GRADIENTS = {"saliency_map": saliency_map, "integrated_gradients": integrated_gradients, "gradient_shap": gradient_shap, "deep_lift": deep_lift}


def gradient_attribution(model: Predictor, x: np.ndarray, method: str = "saliency_map", **options) -> np.ndarray:
    return _GRADIENTS[method](model, x, **options)


def lstm_hidden_state(model: Predictor, x: np.ndarray) -> np.ndarray:
    """(row, unit): the last layer's state after each row's sequence."""
    if not hasattr(model, "hidden"):
        raise TypeError("the model has no hidden state")
    return model.hidden(x)


def mrf_gtvp(x: np.ndarray, y: np.ndarray, min_samples_leaf: int = 10, n_estimators: int = 30, ridge_alpha: float = 1.0, random_state: int = 0) -> np.ndarray:
    """(row, 1 + columns): intercept and slopes that a forest of local regressions gives each row, averaged over the trees."""
    from .kernels import _forest, ridge

    out, path = _forest(x, y, n_estimators, 1 / 3, None, min_samples_leaf, random_state, True, False), np.zeros((len(x), 1 + x.shape[1]))
    for t, ids in out:
        leaf = t.leaves(x)
        for i in np.unique(leaf):
            f = ridge(x[ids[t.members[i]]], y[ids[t.members[i]]], ridge_alpha)
            path[leaf == i] += np.concatenate([[f.intercept], f.coef]) / n_estimators
    return path


def accumulated_local_effect_2d(model: Predictor, x: np.ndarray, a: int, b: int, bins: int = 10) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(surface, counts, edges, edges) of the pure interaction of two columns: second differences over quantile cells, summed up, main effects taken out."""
    ea, eb = (np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1))) for j in (a, b))
    if min(len(ea), len(eb)) < 3:
        raise ValueError("each column needs two bins or more")
    ia, ib = (np.searchsorted(e[1:-1], x[:, j], "right") for e, j in ((ea, a), (eb, b)))
    size = (len(ea) - 1, len(eb) - 1)
    cell = ia * size[1] + ib
    corner = {}
    for s in (0, 1):
        for t in (0, 1):
            z = x.copy()
            z[:, a], z[:, b] = ea[ia + s], eb[ib + t]
            corner[s, t] = model(z)
    second = corner[1, 1] - corner[0, 1] - corner[1, 0] + corner[0, 0]
    n = np.bincount(cell, minlength=size[0] * size[1]).reshape(size)
    local = np.bincount(cell, second, size[0] * size[1]).reshape(size) / np.maximum(n, 1)
    total, w = local.cumsum(0).cumsum(1), n / n.sum()
    rows, cols = (total * w).sum(1, keepdims=True) / np.maximum(w.sum(1, keepdims=True), 1e-12), (total * w).sum(0, keepdims=True) / np.maximum(w.sum(0, keepdims=True), 1e-12)
    return total - rows - cols + (total * w).sum(), n, ea, eb


# Attention forms of least squares.


def ridge_attention_weights(x_train: np.ndarray, x_test: np.ndarray | None = None, alpha: float = 1.0) -> np.ndarray:
    from .interpret import ols_attention_weights

    return ols_attention_weights(x_train, x_train if x_test is None else x_test, alpha)


def ols_attention_embedding(x_train: np.ndarray, x_test: np.ndarray | None = None, ridge: float = 0.0, tol: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """Train and test embeddings whose inner products are the attention weights."""
    a, b = (np.column_stack([np.ones(len(v)), v]) for v in (x_train, x_train if x_test is None else x_test))
    w, q = np.linalg.eigh(np.linalg.pinv(a.T @ a + ridge * np.diag([0.0, *np.ones(x_train.shape[1])])))
    keep = w > tol
    root = q[:, keep] * np.sqrt(w[keep])
    return a @ root, b @ root


def ols_attention_equivalence(x_train: np.ndarray, y_train: np.ndarray, x_test: np.ndarray | None = None, ridge: float = 0.0) -> dict[str, float]:
    """Greatest differences between least-squares predictions, weights times targets, and embeddings."""
    from .interpret import ols_attention_weights
    from .kernels import ols

    test = x_train if x_test is None else x_test
    w = ols_attention_weights(x_train, test, ridge)
    a, b = ols_attention_embedding(x_train, test, ridge)
    plain = ols(x_train, y_train)(test) if ridge == 0 else w @ y_train
    return {"prediction_gap": float(np.abs(w @ y_train - plain).max()), "embedding_gap": float(np.abs(b @ a.T - w).max()), "row_sum_gap": float(np.abs(w.sum(1) - 1).max())}


# Sums and closed forms over tables.


def episode_group_weights(weights: DataFrame, groups: Mapping[str, Sequence[object]], y_train: DataFrame | None = None) -> DataFrame:
    """date, episode_group: sums of observation weights (date, source_date, weight), and of contributions where targets are given."""
    named = [F.when(F.col("source_date").isin(list(v)), F.lit(k)) for k, v in groups.items()]
    rows = weights.withColumn("episode_group", F.coalesce(*named, F.lit("other")))
    aggs = [F.sum("weight").alias("weight"), F.sum(F.abs("weight")).alias("abs_weight"), F.countDistinct("source_date").alias("n_episodes")]
    if y_train is not None:
        rows = rows.join(y_train, "source_date").withColumn("c", F.col("weight") * F.col("y"))
        aggs += [F.sum("c").alias("contribution"), F.sum(F.abs("c")).alias("abs_contribution")]
    return rows.groupBy("date", "episode_group").agg(*aggs)


group_observation_weights = episode_group_weights


def lineage_attribution(table: DataFrame, lineage: DataFrame, level: str = "pipeline", value: str = "importance", aggregation: str = "sum") -> DataFrame:
    """Importances (feature, value) summed by a column of ``lineage`` (feature, ...); features without one are ``unknown``."""
    rows = table.join(lineage.select("feature", level), "feature", "left").withColumn(level, F.coalesce(level, F.lit("unknown")))
    how = {"sum": F.sum, "mean": F.avg, "max": F.max}[aggregation]
    return rows.groupBy(level).agg(how(value).alias(value), F.countDistinct("feature").alias("n_features"))


def transformation_attribution(evaluation: DataFrame, pipeline: str = "model", metric: str = "mse", by: Sequence[str] = ("target", "horizon"), method: str = "shapley_over_pipelines", lower_is_better: bool = True, baseline: str = "worst") -> DataFrame:
    """by, pipeline, loss, utility, contribution, baseline.

    A set of pipelines is worth the mean utility (gain over the baseline) of its members.  The Shapley value of
    that game has a closed form: (u H(n) - (U - u) (H(n) - 1) / (n - 1)) / n, with H the harmonic number.
    """
    if method not in ("shapley_over_pipelines", "marginal_addition", "leave_one_out_pipeline"):
        raise ValueError(f"unknown method {method}")
    rows, w = evaluation.groupBy(*by, pipeline).agg(F.avg(metric).alias("loss")), Window.partitionBy(*by)
    edge = {"worst": F.max if lower_is_better else F.min, "best": F.min if lower_is_better else F.max, "mean": F.avg}[baseline]
    rows = rows.withColumn("baseline", edge("loss").over(w))
    rows = rows.withColumn("utility", F.col("baseline") - F.col("loss") if lower_is_better else F.col("loss") - F.col("baseline"))
    n, total, u = F.count(F.lit(1)).over(w), F.sum("utility").over(w), F.col("utility")
    others = F.coalesce(ratio(total - u, n - 1), F.lit(0.0))
    harmonic = F.aggregate(F.sequence(F.lit(1), F.col("n").cast("int")), F.lit(0.0), lambda s, k: s + 1 / k)
    value = {
        "marginal_addition": u, "leave_one_out_pipeline": F.when(F.col("n") > 1, F.col("whole") / F.col("n") - F.col("others")).otherwise(0.0),
        "shapley_over_pipelines": (u * harmonic - F.col("others") * (harmonic - 1)) / F.col("n"),
    }[method]
    rows = rows.withColumns({"n": n, "whole": total, "others": others})
    return rows.select(*by, F.col(pipeline).alias("pipeline"), "loss", "utility", value.alias("contribution"), "baseline")


def performance_shapley_value(contributions: DataFrame, key: Sequence[str] = ("date",), value: str = "contribution", local: bool = False) -> DataFrame:
    """Squared-loss Shapley values of additive forecasts (key, feature, contribution, base_value, actual).

    A set S of features is worth (actual - base - sum of S)^2, so the value of a feature is
    its contribution times (sum of all - 2 (actual - base)).  ``local`` keeps a row per key; else means by feature.
    """
    w = Window.partitionBy(*key)
    total, r = F.sum(value).over(w), F.col("actual") - F.col("base_value")
    rows = contributions.withColumns({"pbsv": F.col(value) * (total - 2 * r), "baseline_loss": r * r, "full_loss": F.pow(r - total, 2)})
    if local:
        return rows.select(*key, "feature", F.col(value).alias("forecast_contribution"), "pbsv", "baseline_loss", "full_loss")
    return rows.groupBy("feature").agg(F.avg("pbsv").alias("pbsv"), F.avg(F.abs("pbsv")).alias("abs_pbsv"), F.count(F.lit(1)).alias("n_rows"), F.avg("baseline_loss").alias("baseline_loss"), F.avg("full_loss").alias("full_loss"))


pbsv = performance_based_shapley_value = performance_shapley_value


def oshapley_vi(contributions: DataFrame, by: Sequence[str] = ("target", "arm", "horizon"), value: str = "contribution") -> DataFrame:
    """Mean absolute contribution to out-of-sample forecasts; the base is left out."""
    rows = contributions.where("feature <> '__base__'").groupBy(*by, "feature").agg(F.avg(F.abs(value)).alias("importance"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("importance").desc(), "feature")))


# Forecast anatomy: one grouped job over target x arm x horizon.


def window_to_anatomy_subsets(n: int, first_origin: int, h: int = 1, step: int = 1, window: int | None = None) -> list[tuple[int, int, int]]:
    """(first row, row after the last, origin) of the rows each origin may train on."""
    return [(max(0, o + 1 - window) if window else 0, o - h + 1, o) for o in range(first_origin, n - h, step)]


window_to_oshapley_subsets = window_to_anatomy_subsets
ANATOMY_SCHEMA = "target string, arm string, horizon int, origin_pos int, date date, feature string, contribution double, base_value double, prediction double, actual double"


def anatomy_provider(long: DataFrame, arms: Sequence[Arm], horizons: Sequence[int] = (1,)) -> DataFrame:
    """A row for each target, arm and horizon, with its rows."""
    cells = long.sparkSession.createDataFrame([(i, h) for i in range(len(arms)) for h in horizons], "cell int, horizon int")
    return long.crossJoin(F.broadcast(cells))  # arms x horizons: the study's size


oshapley_provider = anatomy_provider


def anatomy_model(arm: Arm) -> Callable[[np.ndarray, np.ndarray], Predictor]:
    fit = get_model(arm.model).fit
    return lambda x, y: fit(x, y, **arm.params)


def anatomy_output_transform(metric: str = "forecast") -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """What of a forecast is explained: itself, or its loss."""
    return {"forecast": lambda p, y: p, "squared_error": lambda p, y: (p - y) ** 2, "absolute_error": lambda p, y: np.abs(p - y)}[metric]


anatomy_output_transformer = anatomy_output_transform


def precompute_anatomy(
    long: DataFrame, arms: Sequence[Arm], horizons: Sequence[int] = (1,), first_origin: int = 36, step: int = 1, window: int | None = None,
    predictors: Sequence[str] = (), background: int = 32, metric: str = "forecast", n_iterations: int = 32,
) -> DataFrame:
    """Contribution of every feature to every out-of-sample forecast (or its loss) of a study.

    Each origin's model is fitted on what it may know; the background is up to ``background`` evenly spaced training rows.
    """
    held, transform = list(arms), anatomy_output_transform(metric)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        arm, h, y = held[int(pdf["cell"].iloc[0])], int(pdf["horizon"].iloc[0]), pdf["y"].to_numpy(float)
        x = pdf[list(predictors)].to_numpy(float) if predictors else None
        z, dates, out, fit = _design(y, x, arm.lags), pdf["date"].to_numpy(), [], anatomy_model(arm)
        names = [f"lag{k}" for k in range(arm.lags)] + list(predictors)
        for a, b, o in window_to_anatomy_subsets(len(y), first_origin, h, step, window):
            rows = np.arange(a, b)
            ok = np.isfinite(z[rows]).all(1) & np.isfinite(y[rows + h])
            if ok.sum() < 5 or not np.isfinite(z[o]).all():
                continue
            model = fit(z[rows][ok], y[rows + h][ok])
            some = z[rows][ok][np.unique(np.linspace(0, ok.sum() - 1, min(background, ok.sum())).astype(int))]
            told, base = shapley_rows(lambda v: transform(model(v), y[o + h]), z[o][None], some, n_iterations)  # noqa: B023
            p = float(model(z[o][None])[0])
            out += [(pdf["target"].iloc[0], arm.name, h, o, dates[o + h], f, v, base, p, y[o + h]) for f, v in zip(names, told[0])]
        return pd.DataFrame(out, columns=[c.split()[0] for c in ANATOMY_SCHEMA.split(", ")])

    return anatomy_provider(long, held, horizons).groupBy("target", "cell", "horizon").applyInPandas(work, ANATOMY_SCHEMA)


precompute_oshapley = precompute_anatomy


@dataclass
class AnatomyPipelineResult:
    contributions: DataFrame
    importance: DataFrame
    performance: DataFrame


def anatomy_explain(contributions: DataFrame, output: str = "long") -> DataFrame:
    """The contributions as they are, or one column a feature."""
    if output == "long":
        return contributions
    return contributions.groupBy("target", "arm", "horizon", "date", "base_value", "prediction").pivot("feature").agg(F.first("contribution"))


def anatomy_pipeline(long: DataFrame, arms: Sequence[Arm], **options) -> AnatomyPipelineResult:
    c = precompute_anatomy(long, arms, **options)
    keys = ("target", "arm", "horizon", "date")
    local = performance_shapley_value(c, keys, local=True)
    by = local.groupBy("target", "arm", "horizon", "feature").agg(F.avg("pbsv").alias("pbsv"), F.avg(F.abs("pbsv")).alias("abs_pbsv"))
    return AnatomyPipelineResult(c, oshapley_vi(c), by)


oshapley_pipeline = anatomy_pipeline


def forecast_shapley_output(value: AnatomyPipelineResult, output: str = "oshapley") -> DataFrame:
    return {"oshapley": value.importance, "pbsv": value.performance, "contributions": value.contributions}[output]


oshapley_output = forecast_shapley_output


def anatomy_from_forecast_result(forecasts: DataFrame, long: DataFrame, arms: Sequence[Arm], **options) -> AnatomyPipelineResult:
    """The anatomy of the forecasts that a table (target, model, horizon, date) holds."""
    result = anatomy_pipeline(long, arms, **options)
    there = forecasts.select("target", F.col("model").alias("arm"), "horizon", "date").distinct()
    result.contributions = result.contributions.join(there, ["target", "arm", "horizon", "date"], "left_semi")
    result.importance = oshapley_vi(result.contributions)
    return result


oshapley_from_forecast_result = anatomy_from_forecast_result


# Interpretation of the arms of a study.


@dataclass
class DualInterpretationResult:
    """Observation weights (date, source_date, weight) and what they sum to by date."""

    weights: DataFrame
    diagnostics: DataFrame


def dual_weights(long: DataFrame, arm: Arm, first_origin: int, h: int = 1) -> DataFrame:
    """target, date, source_date, weight: the forecast as weights on earlier targets, for least squares and ridge arms."""
    from .interpret import ols_attention_weights

    if arm.model not in ("ols", "ridge"):
        raise ValueError("only least squares and ridge are linear in the targets")
    alpha = float(arm.params.get("alpha", 1.0)) if arm.model == "ridge" else 0.0

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        y, dates, out = pdf["y"].to_numpy(float), pdf["date"].to_numpy(), []
        z = _design(y, None, arm.lags)
        for _, b, o in window_to_anatomy_subsets(len(y), first_origin, h):
            rows = np.arange(0, b)
            ok = np.isfinite(z[rows]).all(1) & np.isfinite(y[rows + h])
            x = z[rows][ok]
            if len(x) < 2 or not np.isfinite(z[o]).all():
                continue
            w = ols_attention_weights(x, z[o][None], alpha)[0]
            out.append(pd.DataFrame({"target": pdf["target"].iloc[0], "date": dates[o + h], "source_date": dates[rows[ok] + h], "weight": w}))
        return pd.concat(out) if out else pd.DataFrame(columns=["target", "date", "source_date", "weight"])

    return long.groupBy("target").applyInPandas(work, "target string, date date, source_date date, weight double")


def dual_from_forecast_result(long: DataFrame, arm: Arm, first_origin: int, h: int = 1) -> DualInterpretationResult:
    w = dual_weights(long, arm, first_origin, h)
    g = w.groupBy("target", "date").agg(F.sum(F.col("weight") * F.col("weight")).alias("hhi"), F.sum(F.abs("weight")).alias("leverage"), F.sum("weight").alias("total"))
    return DualInterpretationResult(w, g)


def _coefficients(model, x, y):
    return np.asarray(model.coef) if hasattr(model, "coef") else _gradient(model, x).mean(0)


METHODS: dict[str, Callable[[Predictor, np.ndarray, np.ndarray], np.ndarray]] = {
    "linear_coef": _coefficients,
    "permutation_importance": lambda m, x, y: permutation_importance(m, x, y),
    "shap_importance": lambda m, x, y: np.abs(shapley_rows(m, x[-20:], x[:: max(1, len(x) // 32)])[0]).mean(0),
    "saliency_map": lambda m, x, y: saliency_map(m, x).mean(0),
    "integrated_gradients": lambda m, x, y: np.abs(integrated_gradients(m, x, x.mean(0))).mean(0),
}


def custom_interpretation(name: str, func: Callable[[Predictor, np.ndarray, np.ndarray], np.ndarray]) -> None:
    """Add a method: (model, x, y) to one value a feature."""
    METHODS[name] = func


def interpret_arm(long: DataFrame, arm: Arm, methods: Sequence[str], predictors: Sequence[str] = ()) -> DataFrame:
    """target, method, feature, value of one arm fitted on all rows of each target, one step ahead."""
    asked = {m: METHODS[m] for m in methods}

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        y = pdf["y"].to_numpy(float)
        z = _design(y, pdf[list(predictors)].to_numpy(float) if predictors else None, arm.lags)[:-1]
        t, names = y[1:], [f"lag{k}" for k in range(arm.lags)] + list(predictors)
        ok = np.isfinite(z).all(1) & np.isfinite(t)
        model = get_model(arm.model).fit(z[ok], t[ok], **arm.params)
        out = [(pdf["target"].iloc[0], m, f, float(v)) for m, g in asked.items() for f, v in zip(names, g(model, z[ok], t[ok]))]
        return pd.DataFrame(out, columns=["target", "method", "feature", "value"])

    return long.groupBy("target").applyInPandas(work, "target string, method string, feature string, value double")
