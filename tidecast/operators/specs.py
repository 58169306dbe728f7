"""Feature recipes: declared once, fitted on a training window, applied to any panel."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import factors, features, select
from ._base import DATE, ordered, value_columns
from .kernels import _scaled


@dataclass
class FeatureSet:
    """Date, features and targets in one frame, with the names of both."""

    frame: DataFrame
    features: tuple[str, ...]
    targets: tuple[str, ...]
    metadata: dict[str, object] = field(default_factory=dict)

    @property
    def X(self) -> DataFrame:  # noqa: N802
        return self.frame.select(DATE, *self.features)

    @property
    def y(self) -> DataFrame:
        return self.frame.select(DATE, *self.targets)


@dataclass(frozen=True)
class FeatureSpec:
    targets: tuple[str, ...]
    horizons: tuple[int, ...] = (1,)
    predictors: tuple[str, ...] | None = None  # None: all but the targets
    lags: tuple[int, ...] = (0, 1)
    target_lags: tuple[int, ...] = ()
    rolling_windows: tuple[int, ...] = ()
    rolling_min_periods: int | None = None
    add_time: bool = False
    time_month: bool = False
    time_quarter: bool = False
    time_year: bool = False
    pca_components: int | None = None
    pca_columns: tuple[str, ...] | None = None
    pca_scale: bool = True
    pca_prefix: str = "pc"
    steps: tuple[Callable[[DataFrame], DataFrame], ...] = ()
    include_original: bool = False
    target_transform: str = "level"
    target_mode: str = "direct"  # direct, average
    drop_missing: bool = True

    def to_dict(self) -> dict[str, object]:
        return {**{k: v for k, v in asdict(self).items() if k != "steps"}, "steps": len(self.steps)}

    to_metadata = to_dict

    def fit(self, panel: DataFrame) -> FittedFeatureBuilder:
        missing = {*self.targets, *(self.predictors or ()), *(self.pca_columns or ())} - set(panel.columns)
        if missing:
            raise ValueError(f"the panel has no {sorted(missing)}")
        names = self.predictors or tuple(c for c in value_columns(panel, None) if c not in self.targets)
        return FittedFeatureBuilder(self, names, _pca_state(panel, self, names) if self.pca_components else None)

    def fit_transform(self, panel: DataFrame) -> FeatureSet:
        return self.fit(panel).transform(panel)


def _pca_state(panel: DataFrame, spec: FeatureSpec, names: Sequence[str]) -> dict[str, object]:
    """Means, scales and loadings from second moments: one aggregate row, whatever the panel's length."""
    cols = list(spec.pca_columns or names)
    rows = panel.dropna("any", subset=cols)
    m = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)], *[F.covar_pop(a, b).alias(f"c{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if j >= i]).first()
    if not m["n"]:
        raise ValueError("no complete row to fit components on")
    k = len(cols)
    cov = np.array([[m[f"c{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    sd = np.sqrt(np.diag(cov)) if spec.pca_scale else np.ones(k)
    sd = np.where(sd > 0, sd, 1.0)
    _, v = np.linalg.eigh(cov / np.outer(sd, sd))
    v = v[:, ::-1][:, : spec.pca_components]
    v = v * np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1, 1)  # the greatest loading is positive
    return {"columns": cols, "mean": [float(m[f"m{i}"]) for i in range(k)], "scale": sd.tolist(), "loadings": v.tolist()}


@dataclass(frozen=True)
class FittedFeatureBuilder:
    spec: FeatureSpec
    predictors: tuple[str, ...]
    pca_state: dict[str, object] | None = None

    def to_metadata(self) -> dict[str, object]:
        return {"feature_spec": self.spec.to_dict(), "predictors": list(self.predictors), "pca": self.pca_state}

    def transform(self, panel: DataFrame) -> FeatureSet:
        """Features of every date of ``panel`` with the state of the fit; complete rows only if asked."""
        s, w, made = self.spec, ordered(()), {}
        for c in self.predictors:
            made |= {f"{c}_lag{k}": F.lag(c, k).over(w) if k else F.col(c) for k in s.lags}
            made |= {f"{c}_mean{n}": features.full_mean(c, n, min_periods=s.rolling_min_periods) for n in s.rolling_windows}
        for c in s.targets:
            made |= {f"{c}_lag{k}": F.lag(c, k).over(w) if k else F.col(c) for k in s.target_lags}
        if self.pca_state:
            st = self.pca_state
            z = [(F.col(c) - m) / d for c, m, d in zip(st["columns"], st["mean"], st["scale"])]
            for i in range(s.pca_components):
                made[f"{s.pca_prefix}{i + 1}"] = reduce(lambda a, b: a + b, [v * row[i] for v, row in zip(z, st["loadings"])])
        out = panel.withColumns(made)
        names = [*(self.predictors if s.include_original else ()), *made]
        before = set(out.columns)
        if s.add_time:
            out = features.time_features(out, True, s.time_month, s.time_quarter, s.time_year)
        for step in s.steps:
            out = out.transform(step)
        names += [c for c in out.columns if c not in before]
        before = set(out.columns)
        for c in s.targets:
            out = features.average_target(out, c, s.horizons, s.target_transform) if s.target_mode == "average" else features.direct_target(out, c, s.horizons, s.target_transform)
        targets = [c for c in out.columns if c not in before]
        out = out.select(DATE, *names, *targets)
        return FeatureSet(out.dropna("any") if s.drop_missing else out, tuple(names), tuple(targets), self.to_metadata())


def _many(x) -> tuple:
    return () if x is None else tuple(x) if isinstance(x, (list, tuple, set, range)) else (x,)


def feature_spec(*, target: str | None = None, targets: Sequence[str] | None = None, horizon: int | None = None, horizons: Sequence[int] | int | None = None, predictors: Sequence[str] | str | None = None, lags=(0, 1), target_lags=None, rolling_windows=None, pca_columns=None, steps=None, **options) -> FeatureSpec:
    names = _many(targets) or _many(target)
    if not names:
        raise ValueError("a recipe needs a target")
    ahead = _many(horizons) or _many(horizon) or (1,)
    if min(ahead) < 1 or min(_many(lags), default=0) < 0:
        raise ValueError("horizons are positive and lags not negative")
    chosen = None if predictors in (None, "all") else _many(predictors)
    return FeatureSpec(names, ahead, chosen, _many(lags), _many(target_lags), _many(rolling_windows), pca_columns=_many(pca_columns) or None, steps=_many(steps), **options)


# Blocks that chain features and components.


def pca_then_lags(panel: DataFrame, columns: Sequence[str] | None = None, n_components: int = 1, lags: Sequence[int] = (1,), by: Sequence[str] = (), prefix: str = "pc", **o) -> DataFrame:
    """Keys, date, component scores and their lags."""
    pcs = factors.pca_features(panel, columns, n_components, by=by, prefix=prefix, **o)
    return features.lag(pcs, [f"{prefix}{i + 1}" for i in range(n_components)], [k for k in lags if k], by)


def lags_then_pca(panel: DataFrame, columns: Sequence[str] | None = None, lags: Sequence[int] = (0, 1), n_components: int = 1, by: Sequence[str] = (), prefix: str = "lpc", **o) -> DataFrame:
    cols = value_columns(panel, columns, by)
    made = features.lag(panel, cols, [k for k in lags if k], by)
    names = [*(cols if 0 in lags else ()), *[f"{c}_lag{k}" for c in cols for k in lags if k]]
    return factors.pca_features(made, names, n_components, by=by, prefix=prefix, **o)


def moving_average_pca_lags(panel: DataFrame, columns: Sequence[str] | None = None, max_window: int = 12, n_components: int = 1, lags: Sequence[int] = (1,), by: Sequence[str] = (), windows: Sequence[int] | None = None, prefix: str = "mapc", **o) -> DataFrame:
    cols, sizes = value_columns(panel, columns, by), list(windows or range(1, max_window + 1))
    made = features.rolling_mean(panel, cols, sizes, by=by)
    return pca_then_lags(made, [f"{c}_mean{n}" for c in cols for n in sizes], n_components, lags, by, prefix, **o)


def group_pca(panel: DataFrame, groups: Mapping[str, Sequence[str]], n_components: int = 1, by: Sequence[str] = (), **o) -> DataFrame:
    """Components of each named group of columns: ``<group>_pc1`` and so on."""
    parts = [factors.pca_features(panel, list(c), n_components, by=by, prefix=f"{g}_pc", **o) for g, c in groups.items()]
    return reduce(lambda a, b: a.join(b, [*by, DATE]), parts)


def partial_least_squares_features(panel: DataFrame, target: str, columns: Sequence[str] | None = None, n_components: int = 3, by: Sequence[str] = (), prefix: str = "pls", min_train: int = 24) -> DataFrame:
    """Latent scores refitted at every date on its past: the directions of greatest covariance with the target."""
    cols = [c for c in value_columns(panel, columns, by) if c != target]

    def score(x, y, at):
        z, m, s = _scaled(x)
        now, left, e, out = (at - m) / s, z, y - y.mean(), []
        for _ in range(n_components):
            w = left.T @ e
            w /= max(np.linalg.norm(w), 1e-300)
            t = left @ w
            p = left.T @ t / max(t @ t, 1e-300)
            out.append(float(now @ w))
            now, left = now - out[-1] * p, left - np.outer(t, p)
            e = e - t * (t @ e) / max(t @ t, 1e-300)
        return out

    def work(v):
        x, y, out = v[:, :-1], v[:, -1], np.full((len(v), n_components), np.nan)
        ok, seen = np.isfinite(x).all(1), np.isfinite(v).all(1)
        for t in range(len(v)):
            past = np.flatnonzero(seen[: t + 1])
            if ok[t] and len(past) >= min_train:
                out[t] = score(x[past], y[past], x[t])
        return out

    return factors._per_key(panel, [*cols, target], by, work, [f"{prefix}{i + 1}" for i in range(n_components)])


def adaptive_ma_rf_features(panel: DataFrame, columns: Sequence[str] | None = None, n_estimators: int = 100, min_samples_leaf: int = 6, by: Sequence[str] = (), **o) -> DataFrame:
    """The adaptive moving average of every column: ``<column>_ama``."""
    parts = [factors.albama(panel, c, n_estimators, min_samples_leaf, by, **o).select(*by, DATE, F.col("trend").alias(f"{c}_ama")) for c in value_columns(panel, columns, by)]
    return reduce(lambda a, b: a.join(b, [*by, DATE]), parts)


def sliced_inverse_regression_features(panel: DataFrame, target: str, columns: Sequence[str] | None = None, n_components: int = 2, n_slices: int = 10, prefix: str = "sir") -> DataFrame:
    cols = [c for c in value_columns(panel, columns) if c != target]

    def work(v):
        ok = np.isfinite(v).all(1)
        d, out = select.sliced_inverse_regression(v[ok, :-1], v[ok, -1], n_components, n_slices), np.full((len(v), n_components), np.nan)
        full = np.isfinite(v[:, :-1]).all(1)
        out[full] = (v[full, :-1] - v[ok, :-1].mean(0)) @ d
        return out

    return factors._per_key(panel, [*cols, target], (), work, [f"{prefix}{i + 1}" for i in range(n_components)])


def sparse_pca_chen_rohe_features(panel: DataFrame, columns: Sequence[str] | None = None, n_components: int = 2, keep: float = 0.5, prefix: str = "sca") -> DataFrame:
    cols = value_columns(panel, columns)

    def work(x):
        ok, out = np.isfinite(x).all(1), np.full((len(x), n_components), np.nan)
        out[ok] = _scaled(x[ok])[0] @ select.sparse_components(x[ok], n_components, keep)
        return out

    return factors._per_key(panel, cols, (), work, [f"{prefix}{i + 1}" for i in range(n_components)])


def _joined(func: Callable[..., DataFrame], **options) -> Callable[[DataFrame], DataFrame]:
    """A step that adds what ``func`` makes to the panel."""
    return lambda df: df.join(func(df, **options), DATE, "left")


group_pca_step = lambda **o: _joined(group_pca, **o)
partial_least_squares_step = lambda **o: _joined(partial_least_squares_features, **o)
sliced_inverse_regression_step = lambda **o: _joined(sliced_inverse_regression_features, **o)
sparse_pca_chen_rohe_step = lambda **o: _joined(sparse_pca_chen_rohe_features, **o)

_BLOCKS = ("X", "F", "MARX", "MAF", "LEVEL")


def feature_matrix(panel: DataFrame, specification: str | Sequence[str] = "X", columns: Sequence[str] | None = None, level_panel: DataFrame | None = None, lags: Sequence[int] = (0,), max_lag: int = 12, n_factors: int = 8, n_maf_components: int = 2, fit_policy: str = "expanding", drop_missing: bool = False) -> DataFrame:
    """Named blocks side by side, each with its prefix: the panel's lags, its factors and their lags, lag means, lag components, levels."""
    blocks = specification.split("-") if isinstance(specification, str) else list(specification)
    if not blocks or set(blocks) - set(_BLOCKS):
        raise ValueError(f"blocks are {_BLOCKS}")
    cols, parts = value_columns(panel, columns), []
    named = lambda df, names, p: df.select(DATE, *[F.col(n).alias(f"{p}_{n}") for n in names])
    for block in blocks:
        if block == "X":
            later = [k for k in lags if k]
            parts.append(named(features.lag(panel, cols, later), [*(cols if 0 in lags else ()), *[f"{c}_lag{k}" for c in cols for k in later]], "X"))
        elif block == "F":
            made = pca_then_lags(panel, cols, n_factors, lags, prefix="f", fit_policy=fit_policy)
            parts.append(named(made, [c for c in made.columns if c != DATE], "F"))
        elif block == "MARX":
            parts.append(named(features.marx(panel, cols, max_lag), [f"{c}_marx{n}" for c in cols for n in range(1, max_lag + 1)], "MARX"))
        elif block == "MAF":
            for c in cols:
                made = factors.maf_features(panel, c, max_lag, n_maf_components)
                parts.append(named(made, [x for x in made.columns if x != DATE], "MAF"))
        else:
            if level_panel is None:
                raise ValueError("LEVEL needs level_panel")
            parts.append(named(level_panel, value_columns(level_panel, None), "LEVEL"))
    out = reduce(lambda a, b: a.join(b, DATE), parts)
    return out.dropna("any") if drop_missing else out


# Selection by name.


@dataclass(frozen=True)
class FeatureSelectionResult:
    selected: tuple[str, ...]
    scores: dict[str, float]
    method: str


PredictorScreenResult = FeatureSelectionResult
#: Other names of the rules.
_ALIASES = {
    "variance": "variance_selection", "correlation": "correlation_selection", "lasso": "lasso_selection", "lasso_path": "lasso_path_selection", "rfe": "recursive_feature_elimination",
    "recursive": "recursive_feature_elimination", "stability": "stability_selection", "boruta": "boruta_selection", "genetic": "genetic_selection", "ga": "genetic_selection",
}
SELECTIONS = tuple(dict.fromkeys(_ALIASES.values()))


def normalize_feature_selection_method(value: str) -> str:
    name = value.strip().lower().replace("-", "_")
    name = _ALIASES.get(name, name)
    if name not in SELECTIONS:
        raise ValueError(f"unknown selection {value}; one of {SELECTIONS}")
    return name


def normalize_predictor_screen_method(value: str) -> str:
    name = {"t": "marginal_t", "t_stat": "marginal_t", "marginal": "marginal_t", "corr": "correlation"}.get(value.strip().lower().replace("-", "_"), value.strip().lower().replace("-", "_"))
    if name not in ("marginal_t", "correlation"):
        raise ValueError(f"unknown screen {value}")
    return name


def feature_selection_requires_target(method: str) -> bool:
    return normalize_feature_selection_method(method) != "variance_selection"


def select_features(panel: DataFrame, target: str | None = None, columns: Sequence[str] | None = None, n_features: float = 0.5, method: str = "variance_selection", **params) -> FeatureSelectionResult:
    """Columns by one of the rules.  Variances and correlations are aggregates; the other rules fit models on one matrix."""
    name = normalize_feature_selection_method(method)
    cols = [c for c in value_columns(panel, columns) if c != target]
    if feature_selection_requires_target(name) and target is None:
        raise ValueError(f"{name} needs a target")
    if name in ("variance_selection", "correlation_selection"):
        made = features.variance_selection(panel, cols, n_features) if target is None or name == "variance_selection" else features.correlation_selection(panel, target, cols, n_features)
        rows = made.collect()  # a row per kept column
        score = [c for c in made.columns if c != "feature"][0]
        return FeatureSelectionResult(tuple(r["feature"] for r in rows), {r["feature"]: r[score] for r in rows}, name)
    rules = {
        "lasso_selection": select.lasso_selection, "lasso_path_selection": select.lasso_path_selection, "recursive_feature_elimination": select.rfe_selection,
        "genetic_selection": select.genetic_selection,
    }

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(DATE)[[*cols, target]].to_numpy(float)
        v = v[np.isfinite(v).all(1)]
        x, y = v[:, :-1], v[:, -1]
        if name == "stability_selection":
            at, share = select.stability_selection(x, y, **params)
        elif name == "boruta_selection":
            at, share = select.boruta_selection(x, y, **params), None
        else:
            at, share = rules[name](x, y, n_features, **params), None
        return pd.DataFrame({"feature": [cols[int(i)] for i in at], "score": [float(share[int(i)]) if share is not None else float(len(at) - k) for k, i in enumerate(at)]})

    rows = panel.select(DATE, *cols, target).groupBy().applyInPandas(one, "feature string, score double").collect()  # a row per kept column
    return FeatureSelectionResult(tuple(r["feature"] for r in rows), {r["feature"]: r["score"] for r in rows}, name)


# Sparse components tuned by an information criterion.


def normalize_sparse_ic_search(search: str | Mapping[str, object] | None, allowed_params: Sequence[str]) -> dict[str, object] | None:
    """``None``, a criterion's name or {criterion, grid}; the grid may name allowed parameters only."""
    if search is None:
        return None
    said = {"criterion": search, "grid": {}} if isinstance(search, str) else dict(search)
    if said.get("criterion", "bic") not in ("aic", "bic", "aicc"):
        raise ValueError("the criterion is aic, bic or aicc")
    wrong = set(said.get("grid", {})) - set(allowed_params)
    if wrong:
        raise ValueError(f"not searchable: {sorted(wrong)}")
    return {"criterion": said.get("criterion", "bic"), "grid": dict(said.get("grid", {}))}


def select_sparse_ic_params(x: np.ndarray, y: np.ndarray, search: Mapping[str, object], fixed: Mapping[str, object] | None = None) -> dict[str, object]:
    """The grid point whose components, regressed on the target, have the least criterion."""
    from itertools import product

    from .kernels import ols

    z, trials = _scaled(x)[0], []
    for values in product(*search["grid"].values()):
        params = {**(fixed or {}), **dict(zip(search["grid"], values))}
        load = select.sparse_components(x, **params)
        e = y - ols(z @ load, y)(z @ load)
        n, k = len(y), int((load != 0).sum()) + 1
        cost = {"aic": 2 * k, "bic": k * np.log(n), "aicc": 2 * k + 2 * k * (k + 1) / max(n - k - 1, 1)}[search["criterion"]]
        trials.append((float(n * np.log(max(e @ e / n, 1e-300)) + cost), len(trials), params))
    score, _, best = min(trials, key=lambda t: t[:2])
    return {"params": best, "score": score, "criterion": search["criterion"], "n_trials": len(trials)}


def sparse_ic_metadata(result: Mapping[str, object] | None) -> dict[str, object] | None:
    return None if result is None else {"criterion": result["criterion"], "score": result["score"], "selected": dict(result["params"]), "n_trials": result["n_trials"]}


