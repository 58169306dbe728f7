"""Parameter searches: what to try, on which folds, and the trials that come out, scored in one grouped job."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import windows
from .kernels import MODELS, ModelSpec, get_model
from .select import ParamDistribution, genetic_search, random_candidates


class SearchError(ValueError):
    """A search that cannot be made or has no trial that worked."""


@dataclass(frozen=True)
class ValidationSplitterSpec:
    method: str
    explicit_folds: tuple[tuple[int, int, int, int] | int, ...] = ()
    within_fold: str = "fixed"  # fixed, expanding
    params: Mapping[str, object] = field(default_factory=dict)

    def to_dict(self) -> dict[str, object]:
        return {"method": self.method, "explicit_folds": list(self.explicit_folds), "within_fold": self.within_fold, "params": dict(self.params)}


def validation_splitter(method: str, **params) -> ValidationSplitterSpec:
    return ValidationSplitterSpec(method.lower().replace("-", "_"), params=params)


def explicit_folds(boundaries: Sequence[int], within_fold: str = "fixed") -> ValidationSplitterSpec:
    """Folds between given positions; ``expanding`` scores a fold's rows one by one on all before them."""
    if within_fold not in ("fixed", "expanding"):
        raise ValueError("within_fold is fixed or expanding")
    return ValidationSplitterSpec("explicit_folds", tuple(boundaries), within_fold)


def recursive_threefold() -> ValidationSplitterSpec:
    return ValidationSplitterSpec("recursive_threefold")


def resolve_validation_splitter(n: int, splitter: ValidationSplitterSpec | str) -> list[windows.Fold]:
    """(train start, train end, validation start, validation end) of every fold of ``n`` rows."""
    s = validation_splitter(splitter) if isinstance(splitter, str) else splitter
    if s.method == "recursive_threefold":
        cuts = [n * i // 4 for i in range(1, 5)]
        return [(0, a, a, b) for a, b in zip(cuts, cuts[1:])]
    if s.method == "explicit_folds":
        cuts = sorted({int(b) for b in s.explicit_folds if 0 < int(b) < n} | {n})
        if len(cuts) < 2:
            raise SearchError("no fold lies inside the rows")
        folds = [(0, a, a, b) for a, b in zip(cuts, cuts[1:])]
        return [(0, t, t, t + 1) for _, _, a, b in folds for t in range(a, b)] if s.within_fold == "expanding" else folds
    if s.method not in windows.SPLITTERS or s.method == "random_kfold":
        raise SearchError(f"no interval splitter is called {s.method}")
    return windows.make_splitter(s.method, n, **s.params)


@dataclass(frozen=True)
class SearchSpec:
    method: str = "grid"  # grid, random, bayesian, genetic, custom
    param_grid: Mapping[str, tuple] = field(default_factory=dict)
    param_distributions: Mapping[str, ParamDistribution] = field(default_factory=dict)
    n_iter: int = 20
    random_state: int = 0
    population_size: int = 12
    generations: int = 4
    mutation_rate: float = 0.2
    custom_func: Callable[..., Sequence[Mapping[str, object]]] | None = None
    criterion: str = "mse"
    validation_splitter: ValidationSplitterSpec | str = "rolling_blocks"
    score_aggregation: str = "mean_split"  # mean_split, pooled

    def to_metadata(self) -> dict[str, object]:
        said = {k: v for k, v in asdict(self).items() if k not in ("custom_func", "param_distributions", "validation_splitter")}
        s = self.validation_splitter
        return {**said, "validation_splitter": s if isinstance(s, str) else s.to_dict(), "parameters": sorted({*self.param_grid, *self.param_distributions})}

    to_dict = to_metadata

    def to_json(self) -> str:
        return json.dumps(self.to_metadata(), default=str)


@dataclass(frozen=True)
class SearchTrial:
    trial: int
    params: Mapping[str, object]
    score: float
    error: str | None = None


@dataclass(frozen=True)
class SearchResult:
    best_params: Mapping[str, object]
    best_score: float
    trials: tuple[SearchTrial, ...]
    spec: SearchSpec

    def to_frame(self, spark: SparkSession) -> DataFrame:
        return trial_frame(spark, self.trials)

    def to_dict(self) -> dict[str, object]:
        return {"best_params": dict(self.best_params), "best_score": self.best_score, "n_trials": len(self.trials), "search": self.spec.to_metadata()}

    to_metadata = to_dict

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), default=str)


def trial_frame(spark: SparkSession, trials: Sequence[SearchTrial]) -> DataFrame:
    rows = [(t.trial, {k: str(v) for k, v in t.params.items()}, t.score, t.error) for t in trials]
    return spark.createDataFrame(rows, "trial int, params map<string,string>, score double, error string")


def parameter_columns(trials: Sequence[SearchTrial]) -> list[str]:
    return sorted({k for t in trials for k in t.params})


def search_spec(model: str | ModelSpec, **options) -> SearchSpec:
    """A search over the space that the registry holds for a model."""
    spec = get_model(model) if isinstance(model, str) else model
    if not spec.search and not options.get("param_grid") and not options.get("param_distributions"):
        raise SearchError(f"{spec.name} has no search space")
    return SearchSpec(**{"param_grid": {k: tuple(v) for k, v in spec.search.items()}, **options})


def custom_search(func: Callable[..., Sequence[Mapping[str, object]]], **options) -> SearchSpec:
    """``func(spec)`` gives the candidates."""
    return SearchSpec("custom", custom_func=func, **options)


def candidate_key(params: Mapping[str, object]) -> tuple:
    return tuple(sorted((k, repr(v)) for k, v in params.items()))


def encode_value(value: object, dist: ParamDistribution) -> float:
    return dist.unit(value)


def encode_params(params: Mapping[str, object], distributions: Mapping[str, ParamDistribution]) -> np.ndarray:
    """A point of the unit cube."""
    return np.array([encode_value(params[k], d) for k, d in distributions.items()])


def sample_unique_params(distributions: Mapping[str, ParamDistribution], rng: np.random.Generator, seen: set, tries: int = 100) -> dict[str, object] | None:
    for _ in range(tries):
        p = {k: d.sample(rng) for k, d in distributions.items()}
        if candidate_key(p) not in seen:
            seen.add(candidate_key(p))
            return p
    return None


def candidate_pool(distributions: Mapping[str, ParamDistribution], rng: np.random.Generator, seen: set, pool_size: int = 200) -> list[dict[str, object]]:
    own = set(seen)
    made = (sample_unique_params(distributions, rng, own) for _ in range(pool_size))
    return [p for p in made if p is not None]


def propose_bayesian_candidate(distributions: Mapping[str, ParamDistribution], trials: Sequence[tuple[Mapping[str, object], float]], rng: np.random.Generator, seen: set, pool_size: int = 200) -> dict[str, object] | None:
    """The pool's point of greatest expected improvement under a Gaussian process on the trials."""
    from ..functions.stats import norm_cdf, norm_pdf

    pool = candidate_pool(distributions, rng, seen, pool_size)
    if not pool:
        return None
    if len(trials) < 2:
        return pool[0]
    x, y = np.array([encode_params(p, distributions) for p, _ in trials]), np.array([v for _, v in trials])
    kernel = lambda a, b: np.exp(-((a[:, None] - b[None]) ** 2).sum(2) / 0.08)
    q = np.array([encode_params(p, distributions) for p in pool])
    y = (y - y.mean()) / max(y.std(), 1e-12)
    kx, inv = kernel(q, x), np.linalg.inv(kernel(x, x) + 1e-4 * np.eye(len(x)))
    sd = np.sqrt(np.maximum(1 - np.einsum("ij,jk,ik->i", kx, inv, kx), 1e-12))
    z = (y.min() - kx @ inv @ y) / sd
    return pool[int(np.argmax(sd * (z * norm_cdf(z) + norm_pdf(z))))]


def _loss(e: np.ndarray, criterion: str) -> float:
    return float({"mse": np.mean(e**2), "rmse": np.sqrt(np.mean(e**2)), "mae": np.mean(np.abs(e))}[criterion])


def evaluate_candidate(model: str, x: np.ndarray, y: np.ndarray, folds: Sequence[windows.Fold], params: Mapping[str, object], criterion: str = "mse", score_aggregation: str = "mean_split") -> float:
    """Mean of the folds' losses, or the loss of all folds' errors together."""
    fit = get_model(model).fit
    errors = [fit(x[a:b], y[a:b], **params)(x[c:d]) - y[c:d] for a, b, c, d in folds]
    return _loss(np.concatenate(errors), criterion) if score_aggregation == "pooled" else float(np.mean([_loss(e, criterion) for e in errors]))


@dataclass(frozen=True)
class PrefixSearchSpec:
    """One fit serves every value of ``parameter`` up to its largest: ``path`` gives predictions by value."""

    parameter: str
    path: Callable[[np.ndarray, np.ndarray, np.ndarray, int], dict[int, np.ndarray]]


def _pcr_path(x: np.ndarray, y: np.ndarray, new: np.ndarray, most: int) -> dict[int, np.ndarray]:
    from .kernels import _scaled

    z, m, s = _scaled(x)
    _, _, v = np.linalg.svd(z, full_matrices=False)
    f, g = z @ v[:most].T, (new - m) / s @ v[:most].T
    b = f.T @ (y - y.mean()) / np.maximum((f**2).sum(0), 1e-300)  # scores are orthogonal
    return {k: y.mean() + g[:, :k] @ b[:k] for k in range(1, most + 1)}


PREFIX_SEARCH = {"pcr": PrefixSearchSpec("n_components", _pcr_path)}


def evaluate_candidate_group(prefix: PrefixSearchSpec, x: np.ndarray, y: np.ndarray, folds: Sequence[windows.Fold], values: Sequence[int], criterion: str = "mse") -> dict[int, float]:
    """Score of every value, from one fit a fold."""
    most, out = min(max(values), x.shape[1]), {v: [] for v in values}
    for a, b, c, d in folds:
        path = prefix.path(x[a:b], y[a:b], x[c:d], most)
        for v in values:
            out[v].append(_loss(path[min(v, most)] - y[c:d], criterion))
    return {v: float(np.mean(s)) for v, s in out.items()}


def _candidates(spec: SearchSpec) -> list[dict[str, object]]:
    from itertools import product

    if spec.method == "custom":
        return [dict(p) for p in spec.custom_func(spec)]
    if spec.param_grid:
        whole = [dict(zip(spec.param_grid, v)) for v in product(*spec.param_grid.values())]
        if spec.method == "grid" or len(whole) <= spec.n_iter:
            return whole
        return [whole[i] for i in np.random.default_rng(spec.random_state).choice(len(whole), spec.n_iter, replace=False)]
    return random_candidates(spec.param_distributions, spec.n_iter, spec.random_state)


def run_search(frame: DataFrame, model: str, x: Sequence[str], y: str, spec: SearchSpec) -> SearchResult:
    """Grid, random and custom searches score all candidates in one job, a candidate a group; Bayesian and genetic ones
    depend on their own trials and run inside one task."""
    n = frame.count()
    folds, cols = resolve_validation_splitter(n, spec.validation_splitter), list(x)
    schema = "trial int, params string, score double, error string"

    def scored(pdf: pd.DataFrame, tries: Sequence[tuple[int, Mapping[str, object]]]) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        xs, ys, out = pdf[cols].to_numpy(float), pdf[y].to_numpy(float), []
        for i, p in tries:
            try:
                out.append((i, repr(p), evaluate_candidate(model, xs, ys, folds, p, spec.criterion, spec.score_aggregation), None))
            except Exception as e:  # a candidate that cannot be fitted must not end the search
                out.append((i, repr(p), np.nan, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["trial", "params", "score", "error"])

    data = frame.select("date", *cols, y)
    if spec.method in ("bayesian", "genetic"):
        tries: list[dict[str, object]] = []

        def sequential(pdf: pd.DataFrame) -> pd.DataFrame:
            made, seen, rng = [], set(), np.random.default_rng(spec.random_state)

            def loss(p):
                made.append(scored(pdf, [(len(made), p)]))
                s = float(made[-1]["score"].iloc[0])
                return s if np.isfinite(s) else 1e300

            if spec.method == "genetic":
                genetic_search(loss, spec.param_distributions, spec.population_size, spec.generations, spec.mutation_rate, spec.random_state)
            else:
                done: list[tuple[dict, float]] = []
                while len(done) < spec.n_iter and (p := propose_bayesian_candidate(spec.param_distributions, done, rng, seen)) is not None:
                    seen.add(candidate_key(p))
                    done.append((p, loss(p)))
            return pd.concat(made)

        rows = data.groupBy().applyInPandas(sequential, schema).collect()  # a row per trial
        import ast

        tries = [ast.literal_eval(r["params"]) for r in sorted(rows, key=lambda r: r["trial"])]
    else:
        tries = _candidates(spec)
        cells = frame.sparkSession.createDataFrame([(i,) for i in range(len(tries))], "cell int")
        each = lambda pdf: scored(pdf, [(int(pdf["cell"].iloc[0]), tries[int(pdf["cell"].iloc[0])])])
        rows = data.crossJoin(F.broadcast(cells)).groupBy("cell").applyInPandas(each, schema).collect()  # candidates: the search's size
    trials = tuple(SearchTrial(r["trial"], tries[r["trial"]], r["score"], r["error"]) for r in sorted(rows, key=lambda r: r["trial"]))
    good = [t for t in trials if t.error is None and t.score is not None and np.isfinite(t.score)]
    if not good:
        raise SearchError("no trial worked")
    best = min(good, key=lambda t: (t.score, t.trial))
    return SearchResult(best.params, best.score, trials, spec)


# What the registry says of a model or an ensemble.


@dataclass(frozen=True)
class ModelParameter:
    name: str
    default: object = None
    search: tuple = ()


def describe_model(model: str) -> list[ModelParameter]:
    import inspect

    spec = get_model(model)
    params = [p for p in inspect.signature(spec.fit).parameters.values() if p.default is not inspect.Parameter.empty]
    known = {p.name: ModelParameter(p.name, p.default, tuple(spec.search.get(p.name, ()))) for p in params}
    return [*known.values(), *[ModelParameter(k, None, tuple(v)) for k, v in spec.search.items() if k not in known]]


def model_search_space(model: str) -> dict[str, list]:
    return dict(get_model(model).search)


def list_model_specs(spark: SparkSession, family: str | None = None, kind: str | None = None) -> DataFrame:
    rows = [(m.name, m.kind, m.family, sorted(m.search)) for m in MODELS.values() if family in (None, m.family) and kind in (None, m.kind)]
    return spark.createDataFrame(rows, "name string, kind string, family string, searchable array<string>")


ENSEMBLES: dict[str, dict[str, object]] = {
    "bagging": {"max_samples": 0.8, "n_estimators": 20}, "subagging": {"max_samples": 0.632, "n_estimators": 20}, "random_subspace": {"max_features": 0.5, "n_estimators": 20},
    "stacking": {"n_splits": 5, "splitter": "forward"}, "booging": {"B": 100, "sample_frac": 0.75}, "super_learner": {"n_splits": 5},
}
_ENSEMBLE_SPACES = {"bagging": {"max_samples": [0.6, 0.8, 1.0]}, "subagging": {"max_samples": [0.5, 0.632]}, "random_subspace": {"max_features": [0.3, 0.5, 0.8]}, "booging": {"sample_frac": [0.5, 0.75]}}


def list_model_ensemble_bases(spark: SparkSession) -> DataFrame:
    return list_model_specs(spark, kind="supervised")


def list_model_ensemble_specs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, {a: str(b) for a, b in v.items()}) for k, v in ENSEMBLES.items()], "name string, defaults map<string,string>")


def get_model_ensemble(name: str, **params) -> dict[str, object]:
    if name not in ENSEMBLES:
        raise KeyError(f"unknown ensemble {name}")
    return {**ENSEMBLES[name], **params, "name": name}


def describe_model_ensemble(name: str) -> list[ModelParameter]:
    return [ModelParameter(k, v, tuple(_ENSEMBLE_SPACES.get(name, {}).get(k, ()))) for k, v in get_model_ensemble(name).items() if k != "name"]


def model_ensemble_search_space(name: str) -> dict[str, list]:
    get_model_ensemble(name)
    return dict(_ENSEMBLE_SPACES.get(name, {}))


def custom_model_ensemble(name: str, fit: Callable, search: Mapping[str, list] | None = None, **defaults) -> ModelSpec:
    """An ensemble that is also a model: ``fit(x, y, **params)`` returns a predictor."""
    ENSEMBLES[name] = dict(defaults)
    _ENSEMBLE_SPACES[name] = dict(search or {})
    MODELS[name] = ModelSpec(name, lambda x, y, **o: fit(x, y, **{**defaults, **o}), "supervised", "ensemble", dict(search or {}))
    return MODELS[name]


# Fits that are kept.


@dataclass
class ModelFit:
    """A predictor with its columns and what is known of it."""

    model: str
    predictor: Callable[[np.ndarray], np.ndarray]
    columns: tuple[str, ...]
    params: dict[str, object] = field(default_factory=dict)
    diagnostics: dict[str, object] = field(default_factory=dict)

    def predict(self, frame: pd.DataFrame | np.ndarray) -> np.ndarray:
        x = frame[list(self.columns)].to_numpy(float) if isinstance(frame, pd.DataFrame) else np.asarray(frame, float)
        return self.predictor(x)

    def transform(self, frame: DataFrame, name: str = "prediction") -> DataFrame:
        """A column of predictions, batch by batch."""
        call = self.predictor

        @F.pandas_udf("double")
        def run(x: pd.Series) -> pd.Series:
            return pd.Series(call(np.array(x.tolist(), float).reshape(len(x), -1)) if len(x) else [], dtype="float64")

        return frame.withColumn(name, run(F.array(*[F.col(c).cast("double") for c in self.columns])))

    def summary(self) -> dict[str, object]:
        return {"model": self.model, "n_features": len(self.columns), **self.params, **self.diagnostics}

    to_dict = to_metadata = summary


@dataclass
class VolatilityFit:
    model: str
    path: Callable[[int], np.ndarray]

    def predict_variance(self, horizon: int = 1) -> np.ndarray:
        return self.path(horizon)

    def conditional_volatility(self, horizon: int = 1) -> np.ndarray:
        return np.sqrt(self.path(horizon))


def fit_volatility(y: np.ndarray, model: str = "garch11", **params) -> VolatilityFit:
    return VolatilityFit(model, lambda h: get_model(model).fit(y, h, **params))


def as_frame(x, prefix: str = "x") -> pd.DataFrame:
    if isinstance(x, pd.DataFrame):
        return x
    v = np.asarray(x, float)
    v = v[:, None] if v.ndim == 1 else v
    return pd.DataFrame(v, columns=[f"{prefix}{i}" for i in range(v.shape[1])])


def as_series(y, name: str = "y") -> pd.Series:
    return y.rename(y.name or name) if isinstance(y, pd.Series) else pd.Series(np.asarray(y, float).reshape(-1), name=name)


def align_xy(x: pd.DataFrame, y: pd.Series) -> tuple[pd.DataFrame, pd.Series]:
    """Rows both have, without missing values."""
    both = x.join(y.rename("__y"), how="inner").dropna()
    return both.drop(columns="__y"), both["__y"].rename(y.name)


def resolve_xy(x, y=None) -> tuple[pd.DataFrame, pd.Series]:
    """A pair, or a frame whose last column is the target."""
    frame = as_frame(x)
    return align_xy(frame, as_series(y)) if y is not None else align_xy(frame.iloc[:, :-1], frame.iloc[:, -1])


def resolve_feature_count(max_features: float | int | str | None, n: int) -> int:
    if max_features is None:
        return n
    if isinstance(max_features, str):
        return max(1, int({"sqrt": np.sqrt, "log2": np.log2}[max_features](n)))
    return max(1, min(n, int(max_features * n) if isinstance(max_features, float) and max_features <= 1 else int(max_features)))


def binary_feature_mask(x) -> np.ndarray:
    v = np.asarray(x, float)
    return np.array([len(np.unique(c[np.isfinite(c)])) == 2 for c in v.T])


def sparse_diagnostics(predictor, x: np.ndarray, y: np.ndarray, tolerance: float = 1e-8) -> dict[str, float]:
    """Criteria of a linear fit whose degrees of freedom are its active coefficients."""
    e, n = y - predictor(x), len(y)
    active = int((np.abs(predictor.coef) > tolerance).sum())
    k, fit = active + 1, n * np.log(max(float(e @ e) / n, 1e-300))
    return {"active": active, "rss": float(e @ e), "aic": fit + 2 * k, "bic": fit + k * np.log(n), "aicc": fit + 2 * k + 2 * k * (k + 1) / max(n - k - 1, 1)}


attach_sparse_ic_diagnostics = sparse_diagnostics


def fit_estimator(model: str, x, y=None, **params) -> ModelFit:
    frame, target = resolve_xy(x, y)
    xs, ys = frame.to_numpy(float), target.to_numpy(float)
    f = get_model(model).fit(xs, ys, **params)
    told = sparse_diagnostics(f, xs, ys) if hasattr(f, "coef") else {"rss": float(((ys - f(xs)) ** 2).sum())}
    return ModelFit(model, f, tuple(frame.columns), params, told)


@dataclass(frozen=True)
class SavedModel:
    path: str
    model: str
    form: str  # linear: coefficients; refit: training rows


def save_fit(spark: SparkSession, fit: ModelFit, path: str, x: np.ndarray | None = None, y: np.ndarray | None = None) -> SavedModel:
    """As JSON: coefficients of a linear fit, else the training rows to fit again (``x`` and ``y`` are needed)."""
    said = {"model": fit.model, "columns": list(fit.columns), "params": fit.params, "diagnostics": fit.diagnostics}
    if hasattr(fit.predictor, "coef"):
        said |= {"form": "linear", "coef": np.asarray(fit.predictor.coef).tolist(), "intercept": float(getattr(fit.predictor, "intercept", 0.0))}
    elif x is not None and y is not None:
        said |= {"form": "refit", "x": np.asarray(x, float).tolist(), "y": np.asarray(y, float).tolist()}
    else:
        raise ValueError("this fit has no coefficients; pass its training rows")
    spark.createDataFrame([(json.dumps(said),)], "value string").write.mode("overwrite").text(path)
    return SavedModel(path, fit.model, said["form"])


def load_fit(spark: SparkSession, path: str) -> ModelFit:
    from .kernels import _linear

    said = json.loads(spark.read.text(path).first()["value"])
    if said["form"] == "linear":
        f = _linear(np.array(said["coef"]), said["intercept"])
    else:
        f = get_model(said["model"]).fit(np.array(said["x"]), np.array(said["y"]), **said["params"])
    return ModelFit(said["model"], f, tuple(said["columns"]), said["params"], said["diagnostics"])
