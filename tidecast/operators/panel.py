"""Panel contract, frequencies, sample bounds, regimes and vintages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._base import DATE, PanelError, finite, melt, ordered, ratio, value_columns


@dataclass(frozen=True)
class DataBundle:
    """A panel and what is known about it."""

    panel: DataFrame
    metadata: Mapping[str, object] = field(default_factory=dict)

    def attach(self, stage: str, values: Mapping[str, object]) -> DataBundle:
        return replace(self, metadata=attach_metadata(self.metadata, stage, values))


@dataclass(frozen=True)
class DataSpec:
    panel: DataFrame
    targets: tuple[str, ...]
    horizons: tuple[int, ...] = (1,)
    predictors: tuple[str, ...] = ()
    metadata: Mapping[str, object] = field(default_factory=dict)


def attach_metadata(metadata: Mapping[str, object], stage: str, values: Mapping[str, object]) -> dict[str, object]:
    held = dict(metadata)
    held[stage] = {**dict(held.get(stage, {})), **values}
    return held


def as_panel(
    frame: DataFrame, date: str = DATE, columns: Sequence[str] | None = None, rename: Mapping[str, str] | None = None,
    by: Sequence[str] = (), strict: bool = True,
) -> DataFrame:
    """Date column, keys and double columns; with ``strict`` what is lost in a cast, or infinite, is an error."""
    rename = dict(rename or {})
    names = list(columns) if columns is not None else [c for c in frame.columns if c not in (date, *by)]
    picked = frame.select(*by, F.to_date(F.col(date)).alias(DATE), *[F.col(c).alias(rename.get(c, c)) for c in names])
    values = [rename.get(c, c) for c in names]
    if strict:
        bad = [
            F.count_if(F.col(c).isNotNull() & (F.expr(f"try_cast(`{c}` as double)").isNull() | (F.abs(F.expr(f"try_cast(`{c}` as double)")) == float("inf")))).alias(c)
            for c in values
        ]
        if bad:
            found = {c: n for c, n in picked.agg(*bad).first().asDict().items() if n}
            if found:
                raise PanelError(f"cells that are no finite numbers: {found}")
    return picked.select(*by, DATE, *[finite(F.expr(f"try_cast(`{c}` as double)")).alias(c) for c in values])


def validate_panel(panel: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Non-empty, unique dates per key, finite values; one aggregate pass."""
    values = value_columns(panel, None, by)
    dup = panel.groupBy(*by, DATE).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("rows"), F.max("n").alias("most"), F.count_if(F.col(DATE).isNull()).alias("undated"))
    found = dup.first()
    if not found["rows"]:
        raise PanelError("the panel is empty")
    if found["most"] > 1 or found["undated"]:
        raise PanelError("dates are missing or not unique")
    odd = panel.agg(*[F.count_if(F.isnan(c) | (F.abs(F.col(c)) == float("inf"))).alias(c) for c in values]).first() if values else None
    if odd and any(odd.asDict().values()):
        raise PanelError(f"values that are not finite: {odd.asDict()}")
    return panel


def panel_info(panel: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: rows, series, first and last date, missing cells."""
    cols = value_columns(panel, columns)
    missing = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in cols], F.lit(0))
    return panel.agg(
        F.count(F.lit(1)).alias("n_rows"), F.lit(len(cols)).cast("bigint").alias("n_series"), F.min(DATE).alias("start"),
        F.max(DATE).alias("end"), missing.cast("bigint").alias("n_missing"),
    )


def spec(
    panel: DataFrame, targets: Sequence[str], horizons: Sequence[int] = (1,), start: str | None = None, end: str | None = None,
    predictors: Sequence[str] | None = None, metadata: Mapping[str, object] | None = None,
) -> DataSpec:
    kept = panel
    if start is not None:
        kept = kept.where(F.col(DATE) >= F.lit(start).cast("date"))
    if end is not None:
        kept = kept.where(F.col(DATE) <= F.lit(end).cast("date"))
    others = tuple(predictors) if predictors is not None else tuple(c for c in value_columns(panel, None) if c not in targets)
    return DataSpec(kept.select(DATE, *targets, *others), tuple(targets), tuple(horizons), others, dict(metadata or {}))


def combine(*panels: DataFrame, on: Sequence[str] = (DATE,)) -> DataFrame:
    """Outer join of the columns; a column in two panels is an error."""
    seen: set[str] = set()
    for p in panels:
        own = set(p.columns) - set(on)
        if own & seen:
            raise PanelError(f"columns in more than one panel: {sorted(own & seen)}")
        seen |= own
    return reduce(lambda a, b: a.join(b, list(on), "full_outer"), panels)


def list_vintages(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Monthly labels ``yyyy-MM`` between two dates."""
    months = F.sequence(F.trunc(F.lit(start).cast("date"), "month"), F.trunc(F.lit(end).cast("date"), "month"), F.expr("interval 1 month"))
    return spark.range(1).select(F.explode(months).alias("month")).select(F.date_format("month", "yyyy-MM").alias("vintage"))


def infer_frequencies(panel: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """series, frequency from the median gap in days between observed dates."""
    long = melt(panel, value_columns(panel, columns, by), [*by, DATE]).where("value IS NOT NULL")
    keys = [*by, "series"]
    gaps = long.withColumn("gap", F.datediff(DATE, F.lag(DATE).over(ordered(keys))))
    median = F.median("gap").alias("days")
    label = (
        F.when(F.col("days").isNull(), "unknown").when(F.col("days").between(5, 9), "weekly").when(F.col("days").between(27, 32), "monthly")
        .when(F.col("days").between(85, 95), "quarterly").when(F.col("days").between(355, 375), "annual").otherwise("irregular")
    )
    return gaps.groupBy(*keys).agg(median).select(*keys, label.alias("frequency"))


def set_frequencies(bundle: DataBundle, frequency_by_column: Mapping[str, str], default: str | None = None) -> DataBundle:
    """The bundle with a frequency for every column; without a default, each must be named."""
    cols = value_columns(bundle.panel, None)
    wrong = (set(frequency_by_column) - set(cols)) | ({c for c in cols if c not in frequency_by_column} if default is None else set())
    if wrong or not set(frequency_by_column.values()) | {default or "monthly"} <= {"daily", "weekly", "monthly", "quarterly", "annual"}:
        raise PanelError(f"frequencies do not fit the columns {sorted(wrong)}")
    return DataBundle(bundle.panel, attach_metadata(bundle.metadata, "frequencies", {c: frequency_by_column.get(c, default) for c in cols}))


def frequency_hardening_issues(frequencies: DataFrame) -> DataFrame:
    return frequencies.where(F.col("frequency").isin("unknown", "irregular"))


def to_lower_frequency(
    panel: DataFrame, unit: str = "quarter", rule: str = "mean", columns: Sequence[str] | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """mean, sum (NULL if nothing is observed), first or last observed value per period."""
    cols = value_columns(panel, columns, by)
    pick = {
        "mean": F.avg,
        "sum": F.sum,
        "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(DATE))),
        "first": lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(DATE))),
    }[rule]
    return panel.groupBy(*by, F.trunc(DATE, unit).alias(DATE)).agg(*[pick(c).alias(c) for c in cols])


def to_monthly(
    panel: DataFrame, rule: str = "step_forward", columns: Sequence[str] | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Quarter starts spread on their months: step_forward, step_backward, repeat_within_quarter, linear."""
    cols = value_columns(panel, columns, by)
    ends = panel.groupBy(*by).agg(F.min(DATE).alias("lo"), F.add_months(F.max(DATE), 2).alias("hi"))
    grid = ends.select(*by, F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias(DATE))
    if rule == "repeat_within_quarter":
        quarter = panel.withColumnRenamed(DATE, "_q")
        return grid.withColumn("_q", F.trunc(DATE, "quarter")).join(quarter, [*by, "_q"], "left").select(*by, DATE, *cols)
    wide = grid.join(panel, [*by, DATE], "left")
    if rule == "linear":
        from .clean import linear_interpolate_clean

        return linear_interpolate_clean(wide, cols, by=by)
    w = ordered(by)
    fill = {
        "step_forward": lambda c: F.last(c, True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "step_backward": lambda c: F.first(c, True).over(w.rowsBetween(0, Window.unboundedFollowing)),
    }[rule]
    return wide.select(*by, DATE, *[fill(c).alias(c) for c in cols])


def align_frequency(panel: DataFrame, method: str = "keep", rule: str | None = None, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    if method == "keep":
        return panel
    if method == "quarterly":
        return to_lower_frequency(panel, "quarter", rule or "mean", columns, by)
    if method == "monthly":
        return to_monthly(panel, rule or "step_forward", columns, by)
    raise PanelError(f"unknown method {method}")


def availability_lag(panel: DataFrame, lags: int | Mapping[str, int] = 1, columns: Sequence[str] | None = None, by: Sequence[str] = (), drop_missing: bool = False) -> DataFrame:
    """Columns seen only after their publication lag."""
    cols = value_columns(panel, columns, by)
    k = {c: lags[c] if isinstance(lags, Mapping) else lags for c in cols if not isinstance(lags, Mapping) or c in lags}
    out = panel.withColumns({c: F.lag(c, n).over(ordered(by)) for c, n in k.items() if n})
    return out.dropna(subset=list(k)) if drop_missing else out


def same_period_predictors(panel: DataFrame, targets: Sequence[str], policy: str = "allow", lag: int = 1, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    cols = [c for c in value_columns(panel, columns, by) if c not in targets]
    if policy == "allow":
        return panel
    if policy == "lag":
        return availability_lag(panel, lag, cols, by)
    if policy == "drop":
        return panel.drop(*cols)
    if policy == "forbid" and cols:
        raise PanelError(f"contemporaneous predictors: {cols}")
    return panel


def define_regime(
    panel: DataFrame, name: str = "regime", column: str | None = None, threshold: float | None = None, direction: str = "above",
    dates: Sequence[tuple[str, str]] = (),
) -> DataFrame:
    """0/1 by a threshold (NULL cells stay NULL) or by date ranges."""
    if column is not None:
        c = F.col(column)
        hit = c > threshold if direction == "above" else c < threshold
        return panel.withColumn(name, F.when(c.isNotNull(), hit.cast("int")))
    inside = reduce(lambda a, b: a | b, [F.col(DATE).between(F.lit(a).cast("date"), F.lit(b).cast("date")) for a, b in dates], F.lit(False))
    return panel.withColumn(name, inside.cast("int"))


# Vintages: a long table (vintage, date, series, value).


def resolve_vintages(vintages: DataFrame, origins: DataFrame) -> DataFrame:
    """origin, vintage: the latest vintage not after each origin; origins without one are left out.

    Vintages and origins are merged in one ordered stream, so no pair of the two tables is formed.
    """
    v = vintages.select(F.col("vintage").alias("at"), F.col("vintage"), F.lit(None).cast("date").alias("origin"), F.lit(0).alias("kind")).distinct()
    o = origins.select(F.col("origin").alias("at"), F.lit(None).cast("date").alias("vintage"), "origin", F.lit(1).alias("kind")).distinct()
    w = Window.orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)  # distinct months only
    return v.unionByName(o).withColumn("vintage", F.last("vintage", True).over(w)).where("kind = 1 AND vintage IS NOT NULL").select("origin", "vintage")


def snapshots(vintages: DataFrame, origins: DataFrame) -> DataFrame:
    """The panel as it was known at each origin."""
    return resolve_vintages(vintages, origins).join(vintages, "vintage")


def actuals(vintages: DataFrame, rule: str = "latest") -> DataFrame:
    """series, date, value of the latest or of the first vintage that has the cell."""
    seen = vintages.where("value IS NOT NULL").groupBy("series", DATE)
    pick = F.max_by if rule == "latest" else F.min_by
    return seen.agg(pick("value", "vintage").alias("value"))


def with_static_extras(snapshot: DataFrame, extra: DataFrame, origin: str) -> DataFrame:
    return snapshot.join(extra, DATE, "full_outer").where(F.col(DATE) <= F.lit(origin).cast("date"))


def growth(c: Column, before: Column) -> Column:
    return ratio(c - before, before)
