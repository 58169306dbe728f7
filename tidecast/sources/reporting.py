"""Output bundles and report tables.

Tables are DataFrames until they are rendered; star marks, ranks and number
formats are column expressions.  Figures are the data of their lines, and an SVG
drawn from that data on the driver, since a figure has few points.
"""

from __future__ import annotations

import json
import platform
import sys
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from html import escape

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .sinks import html_table, latex_table, markdown_table, stars, write_artifacts

KEYS = ("target", "horizon", "model")


@dataclass(frozen=True)
class ArtifactRecord:
    name: str
    kind: str
    columns: tuple[str, ...]
    path: str | None = None


@dataclass
class OutputBundle:
    tables: dict[str, DataFrame]
    metadata: dict[str, object] = field(default_factory=dict)

    def index(self, spark: SparkSession) -> DataFrame:
        return artifact_index(spark, self)

    def write(self, path: str, formats: tuple[str, ...] = ("parquet",)) -> dict[str, object]:
        return write_artifacts(self.tables, path, formats)


def forecast_table(forecasts: DataFrame) -> DataFrame:
    """The columns of a forecast table that are there, in their order."""
    known = ["target", "horizon", "origin", "origin_pos", "date", "model", "arm", "prediction", "actual", "forecast_policy", "variance_prediction", "lower", "upper", "error"]
    return forecasts.select(*[c for c in known if c in forecasts.columns])


def test_table(results: Mapping[str, DataFrame]) -> DataFrame:
    """Test results under each other, with the test's name; columns one lacks are null."""
    parts = [df.withColumn("test", F.lit(name)) for name, df in results.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _rows(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def model_table(spark: SparkSession, fits: Mapping[str, object]) -> DataFrame:
    """name, model, field, value of fits that have a ``summary()``."""
    rows = [(name, str(f.summary().get("model", name)), k, str(v)) for name, f in fits.items() for k, v in f.summary().items() if k != "model"]
    return _rows(spark, rows, "name string, model string, field string, value string")


def model_selection_table(spark: SparkSession, searches: Mapping[str, object]) -> DataFrame:
    """name, trial, params, score, best of search results."""
    rows = [(name, t.trial, {k: str(v) for k, v in t.params.items()}, t.score, dict(t.params) == dict(r.best_params)) for name, r in searches.items() for t in r.trials]
    return _rows(spark, rows, "name string, trial int, params map<string,string>, score double, best boolean")


def interpretation_table(interpretation: Mapping[str, Mapping[str, DataFrame]]) -> DataFrame:
    """arm, method, target, feature, value."""
    parts = [df.withColumns({"arm": F.lit(arm), "method": F.lit(m)}) for arm, by in interpretation.items() for m, df in by.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _flat(value: object, prefix: str) -> list[tuple[str, str]]:
    if isinstance(value, Mapping):
        return [x for k, v in value.items() for x in _flat(v, f"{prefix}.{k}" if prefix else str(k))]
    return [(prefix, value if isinstance(value, str) else json.dumps(value, default=str))]


def metadata_table(spark: SparkSession, metadata: Mapping[str, object], prefix: str = "") -> DataFrame:
    return _rows(spark, _flat(metadata, prefix), "field string, value string")


def run_summary(forecasts: DataFrame) -> DataFrame:
    """One row: what a run holds."""
    return forecasts.agg(
        F.count(F.lit(1)).alias("n_forecasts"), *[F.countDistinct(c).alias(f"n_{c}s") for c in KEYS if c in forecasts.columns],
        F.countDistinct("date").alias("n_dates"), F.min("date").alias("first"), F.max("date").alias("last"), F.sum(F.col("prediction").isNull().cast("int")).alias("n_missing"),
    )


def artifact_index(spark: SparkSession, bundle: OutputBundle) -> DataFrame:
    return _rows(spark, [(r.name, r.kind, list(r.columns)) for r in artifacts(bundle)], "name string, kind string, columns array<string>")


def artifacts(bundle: OutputBundle) -> list[ArtifactRecord]:
    return [ArtifactRecord(k, "table", tuple(v.columns)) for k, v in bundle.tables.items()]


def anatomy_tables(result: object, prefix: str = "anatomy") -> dict[str, DataFrame]:
    return {f"{prefix}_contributions": result.contributions, f"{prefix}_importance": result.importance, f"{prefix}_performance": result.performance}


def forecast_shapley_tables(result: object, prefix: str = "oshapley") -> dict[str, DataFrame]:
    return anatomy_tables(result, prefix)


def interpretation_outputs(interpretation: Mapping[str, Mapping[str, DataFrame]], prefix: str = "interpretation") -> dict[str, DataFrame]:
    return {f"{prefix}_{arm}_{m}": df for arm, by in interpretation.items() for m, df in by.items()}


def bundle_outputs(
    forecasts: DataFrame | None = None, evaluation: Mapping[str, DataFrame] | None = None, tests: Mapping[str, DataFrame] | None = None,
    interpretation: Mapping[str, Mapping[str, DataFrame]] | None = None, more: Mapping[str, DataFrame] | None = None, metadata: Mapping[str, object] | None = None,
) -> OutputBundle:
    tables: dict[str, DataFrame] = {}
    if forecasts is not None:
        tables |= {"forecasts": forecast_table(forecasts), "summary": run_summary(forecasts)}
    tables |= {f"evaluation_{k}": v for k, v in (evaluation or {}).items()}
    if tests:
        tables["tests"] = test_table(tests)
    tables |= interpretation_outputs(interpretation or {}) | dict(more or {})
    return OutputBundle(tables, dict(metadata or {}))


def select_outputs(bundle: OutputBundle, objects: Sequence[str]) -> OutputBundle:
    missing = set(objects) - set(bundle.tables)
    if missing:
        raise KeyError(f"the bundle has no {sorted(missing)}")
    return OutputBundle({k: bundle.tables[k] for k in objects}, bundle.metadata)


def name_outputs(bundle: OutputBundle, convention: str = "descriptive", prefix: str | None = None) -> OutputBundle:
    """``descriptive`` keeps names, ``numbered`` puts 01_, 02_ before them."""
    if convention not in ("descriptive", "numbered"):
        raise ValueError("the convention is descriptive or numbered")
    name = lambda i, k: "_".join(x for x in (prefix, f"{i:02d}" if convention == "numbered" else None, k) if x)
    return OutputBundle({name(i, k): v for i, (k, v) in enumerate(bundle.tables.items(), 1)}, bundle.metadata)


def collect_provenance(spark: SparkSession, fields: Sequence[str] | None = None) -> dict[str, str]:
    from datetime import UTC, datetime

    said = {
        "created": datetime.now(UTC).isoformat(timespec="seconds"), "python": sys.version.split()[0], "spark": spark.version, "platform": platform.platform(),
        "application": spark.sparkContext.applicationId, "time_zone": spark.conf.get("spark.sql.session.timeZone"),
    }
    return {k: v for k, v in said.items() if fields is None or k in fields}


# Report tables.


@dataclass
class ReportTable:
    frame: DataFrame
    caption: str = ""
    label: str = ""
    notes: tuple[str, ...] = ()
    precision: int = 3

    def render(self, fmt: str = "markdown") -> str:
        body = {"markdown": markdown_table, "latex": latex_table, "html": html_table}[fmt](self.frame, self.precision)
        if fmt == "latex":
            tail = "".join(f"\n\\par {n}" for n in self.notes)
            return "\\begin{table}\n" + (f"\\caption{{{self.caption}}}\n" if self.caption else "") + (f"\\label{{{self.label}}}\n" if self.label else "") + body + tail + "\n\\end{table}"
        if fmt == "html":
            return (f"<p>{escape(self.caption)}</p>" if self.caption else "") + body + "".join(f"<p>{escape(n)}</p>" for n in self.notes)
        return "\n\n".join([x for x in (f"**{self.caption}**" if self.caption else "", body, *self.notes) if x])


@dataclass
class ReportBundle:
    tables: dict[str, ReportTable]
    figures: dict[str, str] = field(default_factory=dict)
    metadata: dict[str, object] = field(default_factory=dict)

    def render(self, fmt: str = "markdown") -> str:
        return "\n\n".join(t.render(fmt) for t in self.tables.values())


def report_bundle(tables: Mapping[str, ReportTable] | None = None, figures: Mapping[str, str] | None = None, metadata: Mapping[str, object] | None = None) -> ReportBundle:
    return ReportBundle(dict(tables or {}), dict(figures or {}), dict(metadata or {}))


def _shown(c: str, digits: int, mark: Column | None = None) -> Column:
    text = F.format_number(F.round(c, digits), digits)
    return F.coalesce(F.concat(text, mark) if mark is not None else text, F.lit(""))


def test_report_table(results: DataFrame, columns: Sequence[str] | None = None, precision: int = 3, with_stars: bool = True, caption: str = "", **o) -> ReportTable:
    """Statistics with stars by their p-value."""
    mark = stars("p_value") if with_stars and "p_value" in results.columns else None
    out = results.withColumn("statistic", _shown("statistic", precision, mark))
    if "p_value" in out.columns:
        out = out.withColumn("p_value", _shown("p_value", precision))
    return ReportTable(out.select(*columns) if columns else out, caption, precision=precision, **o)


def forecast_test_table(results: DataFrame, **o) -> ReportTable:
    keep = [c for c in ("target", "horizon", "model", "test", "statistic", "p_value", "p_adjusted", "n") if c in results.columns]
    return test_report_table(results, keep, **o)


def test_provenance_table(results: DataFrame, caption: str = "") -> ReportTable:
    """How many results each test gave, and how many had a p-value."""
    by = [c for c in ("test",) if c in results.columns]
    return ReportTable(results.groupBy(*by).agg(F.count(F.lit(1)).alias("n_results"), F.count("p_value").alias("n_p_values"), F.min("n").alias("least_n")), caption)


def metric_report_table(scores: DataFrame, columns: Sequence[str] | None = None, rename: Mapping[str, str] | None = None, sort_by: Sequence[str] = (), precision: int = 3, percent_columns: Sequence[str] = (), caption: str = "") -> ReportTable:
    doubles = [c for c, t in scores.dtypes if t == "double"]
    out = scores.orderBy(*sort_by) if sort_by else scores
    out = out.withColumns({c: _shown(c, precision) for c in doubles if c not in percent_columns})
    for c in percent_columns:
        out = out.withColumn(c, F.when(F.col(c).isNull(), "").otherwise(F.concat(F.format_number(100 * F.col(c), precision), F.lit("%"))))
    out = out.select(*columns) if columns else out
    return ReportTable(out.withColumnsRenamed(dict(rename or {})), caption)


def accuracy_table(scores: DataFrame, **o) -> ReportTable:
    return metric_report_table(scores, sort_by=("target", "horizon", "rmse"), percent_columns=[c for c in ("r2_oos",) if c in scores.columns], **o)


def model_comparison_table(scores: DataFrame, metric: str = "rmse", **o) -> ReportTable:
    """Scores with the rank within target and horizon."""
    ranked = scores.withColumn("rank", F.rank().over(Window.partitionBy("target", "horizon").orderBy(metric)))
    return metric_report_table(ranked, sort_by=("target", "horizon", "rank"), **o)


def evaluation_report_tables(report: Mapping[str, DataFrame], include: Sequence[str] = ("scores", "ranking", "benchmark", "regime", "decomposition")) -> dict[str, ReportTable]:
    return {k: metric_report_table(report[k], caption=k) for k in include if k in report}


def pairwise_test_frame(forecasts: DataFrame, target: str, horizon: int, value: str = "p_value") -> DataFrame:
    """model, one column a benchmark: the Diebold-Mariano value of each model against each other one."""
    from ..operators import tests_stat

    rows = forecasts.where((F.col("target") == target) & (F.col("horizon") == horizon))
    names = sorted(r["model"] for r in rows.select("model").distinct().collect())  # one row a model
    parts = [tests_stat.dm_test(rows, b).select("model", F.col(value).alias("v"), F.lit(b).alias("benchmark")) for b in names]
    return reduce(DataFrame.unionByName, parts).groupBy("model").pivot("benchmark", names).agg(F.first("v")).orderBy("model")


def pairwise_test_table(forecasts: DataFrame, target: str, horizon: int, value: str = "p_value", precision: int = 3) -> ReportTable:
    out = pairwise_test_frame(forecasts, target, horizon, value)
    shown = out.select("model", *[_shown(c, precision).alias(c) for c in out.columns if c != "model"])
    return ReportTable(shown, f"{target}, horizon {horizon}")


def paper_accuracy_frame(accuracy: DataFrame, significance: DataFrame | None = None, metric: str = "relative_mse", precision: int = 2) -> DataFrame:
    """target, model, one column a horizon: the metric with the stars of the test beside it."""
    rows = accuracy
    mark: Column = F.lit("")
    if significance is not None:
        p = significance.select("target", "horizon", "model", F.col("p_value").alias("p"))
        rows, mark = rows.join(p, ["target", "horizon", "model"], "left"), F.coalesce(stars("p"), F.lit(""))
    rows = rows.withColumn("cell", _shown(metric, precision, mark))
    horizons = sorted(r["horizon"] for r in rows.select("horizon").distinct().collect())  # one row a horizon
    return rows.groupBy("target", "model").pivot("horizon", horizons).agg(F.first("cell")).orderBy("target", "model")


def paper_accuracy_table(accuracy: DataFrame, significance: DataFrame | None = None, metric: str = "relative_mse", caption: str = "", **o) -> ReportTable:
    return ReportTable(paper_accuracy_frame(accuracy, significance, metric, **o), caption, notes=("*** p < 0.01, ** p < 0.05, * p < 0.1",) if significance is not None else ())


# Figures.


def figure_data(data: DataFrame, x: str, y: str, group: str | None = None) -> DataFrame:
    """x, y, group of a figure, without missing values."""
    return data.select(F.col(x).alias("x"), F.col(y).cast("double").alias("y"), (F.col(group) if group else F.lit("")).cast("string").alias("group")).dropna("any")


def line_svg(points: DataFrame, title: str = "", width: int = 640, height: int = 360, level: float | None = None) -> str:
    """Lines of ``figure_data``; ``level`` draws a dashed line."""
    rows = points.orderBy("group", "x").collect()  # what a figure shows
    if not rows:
        return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"/>'
    at = lambda v: v.toordinal() if hasattr(v, "toordinal") else float(v)
    xs, ys = [at(r["x"]) for r in rows], [r["y"] for r in rows] + ([level] if level is not None else [])
    px = lambda v: 40 + (v - min(xs)) / ((max(xs) - min(xs)) or 1) * (width - 60)
    py = lambda v: height - 30 - (v - min(ys)) / ((max(ys) - min(ys)) or 1) * (height - 60)
    colours, groups = ["#4269d0", "#efb118", "#ff725c", "#6cc5b0", "#3ca951", "#a463f2"], sorted({r["group"] for r in rows})
    body = [f'<text x="40" y="20">{escape(title)}</text>']
    for i, g in enumerate(groups):
        path = " ".join(f"{px(at(r['x'])):.1f},{py(r['y']):.1f}" for r in rows if r["group"] == g)
        body.append(f'<polyline fill="none" stroke="{colours[i % len(colours)]}" points="{path}"><title>{escape(g)}</title></polyline>')
    if level is not None:
        body.append(f'<line x1="40" x2="{width - 20}" y1="{py(level):.1f}" y2="{py(level):.1f}" stroke="#888" stroke-dasharray="4"/>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">{"".join(body)}</svg>'


def fluctuation_test_data(forecasts: DataFrame, benchmark: str, target: str, horizon: int, window: int) -> DataFrame:
    """date, model, value: the rolling standardised loss difference."""
    from ..operators import tests_stat

    rows = forecasts.where((F.col("target") == target) & (F.col("horizon") == horizon))
    d = tests_stat.loss_differences(rows, benchmark)
    w = Window.partitionBy("model").orderBy("date")
    part, whole = w.rowsBetween(-(window - 1), 0), Window.partitionBy("model")
    scale = F.sqrt(F.sum(F.col("d") * F.col("d")).over(whole) / (F.count("d").over(whole) - 1))
    return d.select("date", "model", F.when(F.count("d").over(part) == window, F.sqrt(F.lit(float(window))) * F.avg("d").over(part) / scale).alias("value")).dropna("any")


def fluctuation_test_plot(forecasts: DataFrame, benchmark: str, target: str, horizon: int, window: int, critical: float | None = None) -> str:
    data = fluctuation_test_data(forecasts, benchmark, target, horizon, window)
    return line_svg(figure_data(data, "date", "value", "model"), f"{target}, horizon {horizon}, against {benchmark}", level=critical)


def pit_histogram_plot(pit: DataFrame, bins: int = 10, column: str = "pit") -> str:
    from ..operators import tests_stat

    h = tests_stat.pit_histogram(pit, column, bins)
    expected = h.agg(F.avg("expected")).first()[0]
    return line_svg(figure_data(h, "bin", "n"), "probability transforms", level=expected)


def forecast_path_data(forecasts: DataFrame, target: str, horizon: int, models: Sequence[str] | None = None) -> DataFrame:
    """date, line, value: forecasts of each model, and the actual."""
    rows = forecasts.where((F.col("target") == target) & (F.col("horizon") == horizon))
    rows = rows.where(F.col("model").isin(list(models))) if models else rows
    actual = rows.select("date", F.lit("actual").alias("line"), F.col("actual").alias("value")).distinct()
    return rows.select("date", F.col("model").alias("line"), F.col("prediction").alias("value")).unionByName(actual)


def forecast_path_plot(forecasts: DataFrame, target: str, horizon: int, models: Sequence[str] | None = None) -> str:
    return line_svg(figure_data(forecast_path_data(forecasts, target, horizon, models), "date", "value", "line"), f"{target}, horizon {horizon}")
