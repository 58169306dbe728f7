"""A declared study: targets, arms, horizons and evaluation, checked once, run as one grouped job, scored again from its checkpoint."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import norm_cdf
from ..sources.sinks import append_checkpoint, load_checkpoint
from . import combine, metrics, runner, tests_stat
from .runner import SCHEMA, Arm

#: What each transformation code makes of a target, as (policy, transform).
TCODE_TARGET_MAP = {
    1: ("direct", "level"), 2: ("direct_average", "change"), 3: ("direct_average", "change"), 4: ("direct", "level"),
    5: ("direct_average", "log_growth"), 6: ("direct_average", "log_growth"), 7: ("direct_average", "growth"),
}
DENSITY_METRICS = ("gaussian_nll", "crps", "qlike")
INTERVAL_METRICS = ("coverage_rate", "interval_width", "interval_score")
CALIBRATION_TESTS = ("berkowitz", "pit_autocorr", "coverage")


@dataclass(frozen=True)
class TargetSpec:
    """A column to forecast; without a transform its code decides."""

    name: str
    transform: str | None = None
    policy: str | None = None
    annualize: bool = False
    reduce_i2: bool = True


@dataclass(frozen=True)
class ResolvedTarget:
    name: str
    policy: str
    transform: str
    tcode: int | None
    annualize: bool


@dataclass(frozen=True)
class InterpretSpec:
    methods: tuple[str, ...] = ()
    which_fit: str = "auto"
    background: int | None = None
    top_k: int | None = 20


@dataclass(frozen=True)
class CombinationContender:
    """A combination of arms that is scored like an arm."""

    name: str
    method: str = "mean"
    members: tuple[str, ...] = ()
    params: Mapping[str, object] = field(default_factory=dict)


@dataclass(frozen=True)
class SubsampleWindow:
    """Inclusive bounds on target dates, ranges taken out, and dates a state must hold at."""

    start: str | None = None
    end: str | None = None
    exclude: tuple[tuple[str, str], ...] = ()
    mask: tuple[tuple[str, bool], ...] | None = None

    def condition(self, date: str = "date") -> Column:
        d, out = F.col(date).cast("date"), F.lit(True)
        day = lambda x: F.lit(x).cast("date")
        if self.start:
            out = out & (d >= day(self.start))
        if self.end:
            out = out & (d <= day(self.end))
        for a, b in self.exclude:
            out = out & ~d.between(day(a), day(b))
        if self.mask is not None:
            out = out & d.isin([day(x) for x, good in self.mask if good]) if any(g for _, g in self.mask) else F.lit(False)
        return out


@dataclass(frozen=True)
class Evaluation:
    benchmark: str
    metrics: tuple[str, ...] = ("rmse", "relative_mse", "r2_oos")
    tests: tuple[str, ...] = ("dm", "cw", "mcs")
    adjust: str = "holm"
    calibration_alpha: float = 0.05
    subsamples: Mapping[str, SubsampleWindow] = field(default_factory=dict)


@dataclass(frozen=True)
class PipelineSpec:
    data: DataFrame = field(compare=False)
    targets: tuple[ResolvedTarget, ...] = ()
    horizons: tuple[int, ...] = (1,)
    arms: tuple[Arm, ...] = ()
    evaluation: Evaluation = Evaluation("naive")
    combinations: tuple[CombinationContender, ...] = ()
    first_origin: int = 36
    step: int = 1
    window: int | None = None
    interpret: Mapping[str, InterpretSpec] = field(default_factory=dict)
    checkpoint_dir: str | None = None

    def identity(self) -> str:
        """What decides the forecasts, as JSON."""
        said = {"targets": [asdict(t) for t in self.targets], "arms": [asdict(a) for a in self.arms], "horizons": self.horizons, "first": self.first_origin, "step": self.step, "window": self.window}
        return json.dumps(said, sort_keys=True, default=str)


@dataclass
class PipelineReport:
    spec: PipelineSpec
    forecasts: DataFrame
    accuracy: DataFrame
    significance: DataFrame
    mcs: DataFrame | None
    density: DataFrame | None
    calibration: DataFrame | None
    failed_cells: DataFrame
    subsamples: dict[str, DataFrame] = field(default_factory=dict)
    interpretation: dict[str, dict[str, DataFrame]] | None = None
    provenance: dict[str, object] = field(default_factory=dict)

    def to_frame(self, name: str = "accuracy") -> DataFrame:
        return self.subsamples[name] if name in self.subsamples else getattr(self, name)


def resolve_target(target: str | TargetSpec, codes: Mapping[str, int] | None = None, tcode: int | None = None, tcode_map: Mapping[int, tuple[str, str]] | None = None) -> ResolvedTarget:
    spec = target if isinstance(target, TargetSpec) else TargetSpec(target)
    code = tcode if tcode is not None else (codes or {}).get(spec.name)
    known = TCODE_TARGET_MAP | dict(tcode_map or {})
    if spec.transform is not None:
        policy, transform = spec.policy or ("direct" if spec.transform == "level" else "direct_average"), spec.transform
    elif code in known:
        policy, transform = known[code]
        policy = spec.policy or policy
    else:
        raise ValueError(f"target {spec.name!r} needs a transform or a transformation code")
    return ResolvedTarget(spec.name, policy, transform, code, spec.annualize)


def contender_names(arm: Arm) -> list[str]:
    return [arm.name]


def is_vintage_aware(spec: PipelineSpec) -> bool:
    """Whether the long panel carries a vintage of its own for every origin."""
    return "vintage" in spec.data.columns


def pipeline_spec(
    *, data: DataFrame, targets: Sequence[str | TargetSpec], horizons: Sequence[int], arms: Sequence[Arm], evaluation: Evaluation, combinations: Sequence[CombinationContender] = (),
    codes: Mapping[str, int] | None = None, **options,
) -> PipelineSpec:
    """Check and build.  ``data`` is long: target, date, y and any predictors."""
    names = [a.name for a in arms]
    if not arms or len(set(names)) != len(names):
        raise ValueError("arms must be named differently, and there must be one")
    if not horizons or min(horizons) < 1:
        raise ValueError("horizons are positive")
    combined = [c.name for c in combinations]
    if set(combined) & set(names) or len(set(combined)) != len(combined):
        raise ValueError("a combination has the name of an arm or of another")
    if evaluation.benchmark not in {*names, *combined}:
        raise ValueError(f"no contender is called {evaluation.benchmark}")
    for c in combinations:
        if c.method not in combine.METHODS:
            raise ValueError(f"unknown combination {c.method}")
        if set(c.members) - set(names):
            raise ValueError(f"{c.name} combines arms that are not there")
    missing = {"target", "date", "y"} - set(data.columns)
    if missing:
        raise ValueError(f"data has no {sorted(missing)}")
    for a in arms:
        runner.get_model(a.model)
    done = tuple(resolve_target(t, codes) for t in targets)
    return PipelineSpec(data, done, tuple(horizons), tuple(arms), evaluation, tuple(combinations), **options)


def _per_target(spec: PipelineSpec) -> list[DataFrame]:
    """Targets that share a transform are one panel: the column itself, its change, growth or log growth."""
    out, w = [], Window.partitionBy("target").orderBy("date")
    for transform in sorted({t.transform for t in spec.targets}):
        rows = spec.data.where(F.col("target").isin([t.name for t in spec.targets if t.transform == transform]))
        y, before = F.col("y"), F.lag("y").over(w)
        value = {"level": y, "change": y - before, "growth": F.try_divide(y, before) - 1, "log_growth": F.when(y > 0, F.ln(y)) - F.when(before > 0, F.ln(before))}[transform]
        out.append(rows.withColumn("y", value))
    return out


def with_combinations(forecasts: DataFrame, combinations: Sequence[CombinationContender]) -> DataFrame:
    keep = [c for c in ("target", "horizon", "date", "actual", "prediction", "model") if c in forecasts.columns]
    parts = [forecasts]
    for c in combinations:
        rows = forecasts.where(F.col("model").isin(list(c.members))) if c.members else forecasts
        made = combine.METHODS[c.method](rows.select(*keep), **c.params).withColumn("model", F.lit(c.name))
        origin = forecasts.select("target", "horizon", "date", "origin", "origin_pos").distinct()
        parts.append(made.join(origin, ["target", "horizon", "date"]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def run_study(spec: PipelineSpec) -> PipelineReport:
    """Every cell of the study, then its tables."""
    predictors = [c for c in spec.data.columns if c not in ("target", "date", "y", "vintage")]
    parts = [runner.run_arms(rows, spec.arms, spec.horizons, spec.first_origin, spec.step, spec.window, predictors) for rows in _per_target(spec)]
    master = reduce(DataFrame.unionByName, parts)
    if spec.checkpoint_dir:
        spark = master.sparkSession
        append_checkpoint(master, f"{spec.checkpoint_dir}/cells")
        spark.createDataFrame([(spec.identity(),)], "value string").write.mode("overwrite").text(f"{spec.checkpoint_dir}/identity")
        master = load_checkpoint(spark, f"{spec.checkpoint_dir}/cells").select(*[c.split()[0] for c in SCHEMA.split(", ")])
    return score(master, spec)


def score(master: DataFrame, spec: PipelineSpec) -> PipelineReport:
    """All tables of a master table (arm, prediction, actual, error)."""
    e = spec.evaluation
    good = master.where("error IS NULL").drop("model", "error").withColumnRenamed("arm", "model")
    f = with_combinations(good, spec.combinations)
    accuracy = accuracy_against(f, e.benchmark)
    tests = []
    for name, test in (("dm", tests_stat.dm_test), ("cw", tests_stat.clark_west_test)):
        if name in e.tests:
            tests.append(tests_stat.adjust_pvalues(test(f, e.benchmark), e.adjust).withColumn("test", F.lit(name)))
    empty = f.sparkSession.createDataFrame([], "target string, horizon int, model string, n long, statistic double, p_value double, p_adjusted double, test string")
    return PipelineReport(
        spec, f, accuracy, reduce(DataFrame.unionByName, tests, empty), tests_stat.model_confidence_set(f, n_boot=199) if "mcs" in e.tests else None,
        density_table(f, e), calibration_table(f, e), runner.failed_cells(master),
        {name: accuracy_against(f.where(w.condition()), e.benchmark) for name, w in e.subsamples.items()}, provenance={"identity": spec.identity(), "subsamples": subsample_provenance(e)},
    )


def accuracy_against(forecasts: DataFrame, benchmark: str) -> DataFrame:
    """rmse, relative_mse, r2_oos and n_common on the dates shared with the benchmark."""
    scores = metrics.benchmark_comparison(forecasts, benchmark)
    return scores.select("target", "horizon", "model", "rmse", "relative_mse", "r2_oos", F.col("n").alias("n_common"), (F.col("model") == benchmark).alias("is_benchmark"))


def density_table(forecasts: DataFrame, evaluation: Evaluation) -> DataFrame | None:
    """Variance and interval scores of contenders that have them; None if no such metric is asked for."""
    asked = set(evaluation.metrics)
    e = F.col("actual") - F.col("prediction")
    aggs: list[Column] = []
    if asked & set(DENSITY_METRICS):
        if "variance_prediction" not in forecasts.columns:
            raise ValueError("the forecasts carry no variance_prediction")
        v = F.when(F.col("variance_prediction") > 0, F.col("variance_prediction"))
        aggs += [F.avg(0.5 * (F.log(2 * F.pi() * v) + e * e / v)).alias("gaussian_nll"), F.avg(F.when(v.isNotNull(), metrics.crps_row())).alias("crps")]
    if asked & set(INTERVAL_METRICS):
        if not {"lower", "upper"} <= set(forecasts.columns):
            raise ValueError("the forecasts carry no lower and upper")
        aggs += [metrics.coverage_rate().alias("coverage_rate"), metrics.interval_width().alias("interval_width"), metrics.interval_score(alpha=evaluation.calibration_alpha).alias("interval_score")]
    return forecasts.groupBy("target", "horizon", "model").agg(*aggs, F.count(e).alias("n")) if aggs else None


def calibration_table(forecasts: DataFrame, evaluation: Evaluation) -> DataFrame | None:
    """target, horizon, model, test, statistic, p_value, reject, n_obs, coverage_rate of the asked tests."""
    asked, parts, keys = set(evaluation.tests) & set(CALIBRATION_TESTS), [], ["target", "horizon", "model"]
    if not asked:
        return None
    if asked & {"berkowitz", "pit_autocorr"}:
        if "variance_prediction" not in forecasts.columns:
            raise ValueError("the forecasts carry no variance_prediction")
        z = (F.col("actual") - F.col("prediction")) / F.sqrt(F.when(F.col("variance_prediction") > 0, F.col("variance_prediction")))
        rows = forecasts.withColumn("z", z).where("z IS NOT NULL")
        if "berkowitz" in asked:
            parts.append(_berkowitz(rows).withColumns({"test": F.lit("berkowitz"), "coverage_rate": F.lit(None).cast("double")}))
        if "pit_autocorr" in asked:
            pit = rows.withColumn("pit", F.udf(lambda v: float(norm_cdf(v)), "double", useArrow=True)("z"))
            got = tests_stat.pit_autocorrelation_test(pit, "pit", 1, keys)
            parts.append(got.select(*keys, "statistic", "p_value", F.col("n").alias("n_obs"), F.lit("pit_autocorr").alias("test"), F.lit(None).cast("double").alias("coverage_rate")))
    if "coverage" in asked:
        if not {"lower", "upper"} <= set(forecasts.columns):
            raise ValueError("the forecasts carry no lower and upper")
        got = tests_stat.interval_coverage_test(forecasts, evaluation.calibration_alpha, keys)
        parts.append(got.select(*keys, F.col("kupiec").alias("statistic"), F.col("kupiec_p").alias("p_value"), F.col("n").alias("n_obs"), F.lit("coverage").alias("test"), (1 - F.col("miss_rate")).alias("coverage_rate")))
    out = reduce(DataFrame.unionByName, parts)
    return out.select(*keys, "test", "statistic", "p_value", (F.col("p_value") < evaluation.calibration_alpha).alias("reject"), "n_obs", "coverage_rate")


def berkowitz_statistics(rows: DataFrame, z: str = "z", by: Sequence[str] = ("target", "horizon", "model")) -> DataFrame:
    """Likelihood ratio of a standard normal against a first-order autoregression with free mean and variance, given the first value."""
    pair = rows.withColumn("_b", F.lag(z).over(Window.partitionBy(*by).orderBy("date"))).where("_b IS NOT NULL")
    n = F.count(F.lit(1))
    g = pair.groupBy(*by).agg(n.alias("n_obs"), F.sum(F.pow(z, 2)).alias("s0"), F.regr_syy(z, "_b").alias("syy"), F.regr_sxy(z, "_b").alias("sxy"), F.regr_sxx(z, "_b").alias("sxx"))
    rss = F.col("syy") - F.when(F.col("sxx") > 0, F.col("sxy") * F.col("sxy") / F.col("sxx")).otherwise(0.0)
    v = F.when(rss > 0, rss / F.col("n_obs"))
    return g.where("n_obs >= 4").select(*by, "n_obs", (F.col("s0") - F.col("n_obs") * (F.log(v) + 1)).alias("statistic"))


def _berkowitz(rows: DataFrame) -> DataFrame:
    return tests_stat.with_p_value(berkowitz_statistics(rows).withColumn("df", F.lit(3)), "chi2", df_col="df").drop("df")


def subsample_provenance(evaluation: Evaluation) -> dict[str, dict[str, object]] | None:
    """What each window takes, for the record."""
    if not evaluation.subsamples:
        return None
    mask = lambda w: None if w.mask is None else {"n_dates": len(w.mask), "n_true": sum(g for _, g in w.mask)}
    return {n: {"start": w.start, "end": w.end, "exclude": [list(x) for x in w.exclude], "mask_source": "user_series" if w.mask is not None else None, "mask_summary": mask(w)} for n, w in evaluation.subsamples.items()}


def evaluate_cross_policy(forecasts: DataFrame, benchmark: str, benchmark_policy: str, policy_column: str = "forecast_policy", separator: str = "::") -> DataFrame:
    """Every (arm, policy) against the benchmark under one policy."""
    missing = {"target", "horizon", "date", "prediction", "actual", "model", policy_column} - set(forecasts.columns)
    if missing:
        raise ValueError(f"the forecasts have no {sorted(missing)}")
    named = forecasts.withColumn("model", F.concat_ws(separator, "model", policy_column))
    bench = f"{benchmark}{separator}{benchmark_policy}"
    out = accuracy_against(named, bench)
    parts = F.split("model", F.lit(f"\\Q{separator}\\E"))
    return out.select("target", "horizon", F.col("model").alias("contender"), parts[0].alias("arm"), parts[1].alias(policy_column), "rmse", "relative_mse", "r2_oos", "n_common", "is_benchmark")


def rescore(spark: SparkSession, checkpoint_dir: str, spec: PipelineSpec, allow_stale: bool = False) -> PipelineReport:
    """The report of a run from its checkpoint; cells written under another identity are refused unless allowed."""
    was = spark.read.text(f"{checkpoint_dir}/identity").first()
    if not allow_stale and (was is None or was["value"] != spec.identity()):
        raise ValueError("the checkpoint was written by another study; pass allow_stale to score it all the same")
    master = load_checkpoint(spark, f"{checkpoint_dir}/cells").select(*[c.split()[0] for c in SCHEMA.split(", ")])
    master = master.where(F.col("arm").isin([a.name for a in spec.arms]) & F.col("horizon").isin(list(spec.horizons)) & F.col("target").isin([t.name for t in spec.targets]))
    report = score(master, spec)
    report.provenance["rescored_from"] = checkpoint_dir
    return report


def auto_parallelism(n_cells: int, cores: int, reserve: int = 0) -> tuple[int, int]:
    """(cells at once, threads of each); their product is never above the cores."""
    free = max(1, cores - reserve)
    workers = max(1, min(n_cells, free))
    return workers, max(1, free // workers)


def interpret_pipeline(report: PipelineReport, methods: Sequence[str] | None = None, arms: Sequence[str] | None = None) -> dict[str, dict[str, DataFrame]]:
    """arm -> method -> (target, feature, value): each arm fitted once on all rows of each target, inside one grouped job."""
    from .interpret_models import METHODS, interpret_arm

    spec, out = report.spec, {}
    for arm in spec.arms:
        asked = tuple(methods) if methods is not None else spec.interpret.get(arm.name, InterpretSpec()).methods
        if (arms is None or arm.name in arms) and asked:
            if set(asked) - set(METHODS):
                raise ValueError(f"unknown methods {sorted(set(asked) - set(METHODS))}")
            predictors = [c for c in spec.data.columns if c not in ("target", "date", "y", "vintage")]
            table = reduce(DataFrame.unionByName, [interpret_arm(rows, arm, asked, predictors) for rows in _per_target(spec)])
            out[arm.name] = {m: table.where(F.col("method") == m).drop("method") for m in asked}
    report.interpretation = out
    return out


def with_evaluation(spec: PipelineSpec, **changes) -> PipelineSpec:
    return replace(spec, evaluation=replace(spec.evaluation, **changes))
