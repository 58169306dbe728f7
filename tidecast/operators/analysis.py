"""Summaries and comparisons of panels, in long form per series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._base import DATE, melt, ordered, ratio, value_columns, whole

KEY = ["series"]


def long_panel(panel: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return melt(panel, value_columns(panel, columns), [DATE])


def unbiased_skew(c: str) -> Column:
    n = F.count(c)
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def unbiased_kurtosis(c: str) -> Column:
    n = F.count(c).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


def univariate_summary(long: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    return long.groupBy(*by).agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"),
        unbiased_skew("value").alias("skew"), unbiased_kurtosis("value").alias("kurtosis"), F.count("value").alias("n"),
        F.count_if(F.col("value").isNull()).alias("n_missing"),
    )


def sample_coverage(long: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    seen = F.when(F.col("value").isNotNull(), F.col(DATE))
    return long.groupBy(*by).agg(F.min(seen).alias("start"), F.max(seen).alias("end"), F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("n_missing"))


def observation_counts(long: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    return long.groupBy(*by).agg(F.count("value").alias("n"))


def missing_rates(long: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    return long.groupBy(*by).agg(F.avg(F.col("value").isNull().cast("double")).alias("missing_rate"))


def missing_summary(long: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    """Count, rate and longest run of missing rows."""
    gap = F.col("value").isNull()
    island = F.row_number().over(ordered(by)) - F.sum(gap.cast("int")).over(ordered(by).rowsBetween(Window.unboundedPreceding, 0))
    runs = long.withColumn("_g", island).groupBy(*by, "_g").agg(F.count_if(gap).alias("m"), F.count(F.lit(1)).alias("r"))
    return runs.groupBy(*by).agg(F.sum("m").alias("n_missing"), (F.sum("m") / F.sum("r")).alias("missing_rate"), F.max("m").alias("longest_gap"))


def outlier_summary(long: DataFrame, by: Sequence[str] = KEY, iqr_threshold: float = 10.0, zscore_threshold: float = 3.0) -> DataFrame:
    w = whole(by)
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(w)
    s = F.stddev_pop("value").over(w)
    told = long.select(*by, "value", q.alias("q"), s.alias("s"), F.avg("value").over(w).alias("m"))
    iqr = F.col("q")[2] - F.col("q")[0]
    return told.groupBy(*by).agg(
        F.count_if((iqr > 0) & (F.abs(F.col("value") - F.col("q")[1]) > iqr_threshold * iqr)).alias("iqr_outliers"),
        F.count_if((F.col("s") > 0) & (F.abs(F.col("value") - F.col("m")) > zscore_threshold * F.col("s"))).alias("zscore_outliers"),
    )


def _average_rank(long: DataFrame, by: Sequence[str]) -> DataFrame:
    """``value`` replaced by its average rank among the rows of ``by``."""
    w = Window.partitionBy(*by)
    ties = Window.partitionBy(*by, "value")
    r = F.rank().over(w.orderBy("value")) + (F.count(F.lit(1)).over(ties) - 1) / 2
    return long.withColumn("value", r.cast("double"))


def correlation_pairs(long: DataFrame, method: str = "pearson", min_periods: int = 1) -> DataFrame:
    """a, b, corr, n for a < b on the dates both series have."""
    rows = long.where("value IS NOT NULL").select("series", DATE, "value")
    a = rows.select(F.col("series").alias("a"), DATE, F.col("value").alias("x"))
    b = rows.select(F.col("series").alias("b"), DATE, F.col("value").alias("y"))
    both = a.join(b, DATE).where("a < b")
    if method == "spearman":
        w = Window.partitionBy("a", "b")
        rank = lambda c: F.rank().over(w.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("a", "b", c)) - 1) / 2
        both = both.select("a", "b", rank("x").alias("x"), rank("y").alias("y"))
    return both.groupBy("a", "b").agg(F.corr("x", "y").alias("corr"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_periods)


correlation_matrix = correlation_pairs


def joined_cells(raw: DataFrame, clean: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    """series, date, raw, clean over the cells of both long panels.

    Spark computes each side by itself, and sums of doubles may then differ in the last bits: where both come from
    one aggregate, carry the raw value along and give such cells of one computation to ``cell_changes`` and the like.
    """
    return raw.select(*by, DATE, F.col("value").alias("raw")).join(clean.select(*by, DATE, F.col("value").alias("clean")), [*by, DATE])


def cell_changes(cells: DataFrame, tolerance: float = 0.0, by: Sequence[str] = KEY) -> DataFrame:
    """series, date, changed of cells (series, date, raw, clean) whose keys are known; a NaN equals a NaN."""
    same = F.col("raw").eqNullSafe(F.col("clean")) | F.coalesce(F.abs(F.col("raw") - F.col("clean")) <= tolerance, F.lit(False))
    return cells.dropna(subset=[*by, DATE]).select(*by, DATE, (~same).alias("changed"))


def changed_cells(raw: DataFrame, clean: DataFrame, tolerance: float = 0.0, by: Sequence[str] = KEY) -> DataFrame:
    """series, date, changed over the cells of both long panels."""
    return cell_changes(joined_cells(raw, clean, by), tolerance, by)


def change_summary(changed: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    return changed.groupBy(*by).agg(F.count_if("changed").alias("n_changed"), F.avg(F.col("changed").cast("double")).alias("change_rate"))


def changed_cell_summary(raw: DataFrame, clean: DataFrame, tolerance: float = 0.0, by: Sequence[str] = KEY) -> DataFrame:
    return change_summary(changed_cells(raw, clean, tolerance, by), by)


def changed_cell_count(raw: DataFrame, clean: DataFrame, tolerance: float = 0.0) -> DataFrame:
    return changed_cells(raw, clean, tolerance).agg(F.count_if("changed").alias("n_changed"))


def missing_shift(raw: DataFrame, clean: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    a, b = missing_rates(raw, by).withColumnRenamed("missing_rate", "raw"), missing_rates(clean, by).withColumnRenamed("missing_rate", "clean")
    return a.join(b, list(by)).withColumn("shift", F.col("clean") - F.col("raw"))


def ks_statistic(raw: DataFrame, clean: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    """Largest distance of the two empirical distribution functions per series."""
    rows = raw.where("value IS NOT NULL").select(*by, "value", F.lit(1).alias("a")).unionByName(clean.where("value IS NOT NULL").select(*by, "value", F.lit(0).alias("a")))
    return _ks(rows, by)


def _ks(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Of rows ``value`` with a = 1 on one side and 0 on the other."""
    g = rows.groupBy(*by, "value").agg(F.sum("a").alias("na"), F.sum(1 - F.col("a")).alias("nb"))
    w = Window.partitionBy(*by)
    run = w.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    gap = F.abs(F.sum("na").over(run) / F.sum("na").over(w) - F.sum("nb").over(run) / F.sum("nb").over(w))
    return g.select(*by, gap.alias("d")).groupBy(*by).agg(F.max("d").alias("ks"))


def distribution_shift(raw: DataFrame, clean: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    s = lambda d, p: d.groupBy(*by).agg(F.avg("value").alias(f"{p}_mean"), F.stddev_samp("value").alias(f"{p}_sd"))
    j = s(raw, "raw").join(s(clean, "clean"), list(by)).join(ks_statistic(raw, clean, by), list(by))
    return j.select(*by, (F.col("clean_mean") - F.col("raw_mean")).alias("mean_change"), ratio(F.col("clean_sd"), F.col("raw_sd")).alias("sd_ratio"), "ks")


def cell_distribution_shift(cells: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    """``distribution_shift`` of cells (series, raw, clean) of one computation, whose keys are known."""
    known = cells.dropna(subset=list(by))
    m = known.groupBy(*by).agg(*[f(c).alias(f"{c}_{n}") for c in ("raw", "clean") for n, f in (("mean", F.avg), ("sd", F.stddev_samp))])
    side = lambda c, a: F.struct(F.col(c).alias("value"), F.lit(a).alias("a"))
    rows = known.select(*by, F.explode(F.array(side("raw", 1), side("clean", 0))).alias("x")).select(*by, "x.value", "x.a").where("value IS NOT NULL")
    j = m.join(_ks(rows, by), list(by))
    return j.select(*by, (F.col("clean_mean") - F.col("raw_mean")).alias("mean_change"), ratio(F.col("clean_sd"), F.col("raw_sd")).alias("sd_ratio"), "ks")


def correlation_shift(raw: DataFrame, clean: DataFrame, method: str = "pearson") -> DataFrame:
    a, b = correlation_pairs(raw, method), correlation_pairs(clean, method)
    return a.select("a", "b", F.col("corr").alias("r")).join(b.select("a", "b", F.col("corr").alias("c")), ["a", "b"]).select("a", "b", (F.col("c") - F.col("r")).alias("shift"))


def compare_panels(raw: DataFrame, clean: DataFrame, tolerance: float = 0.0) -> dict[str, DataFrame]:
    return {"changed": changed_cell_summary(raw, clean, tolerance), "missing": missing_shift(raw, clean), "distribution": distribution_shift(raw, clean)}


analyze_data = compare_panels


def acf(long: DataFrame, by: Sequence[str] = KEY, nlags: int = 20) -> DataFrame:
    """Autocorrelations with the 95 % Bartlett band of white noise."""
    from .tests_stat import autocorrelations

    return autocorrelations(long, "value", by, nlags).withColumn("band", 1.959963984540054 / F.sqrt("n"))


def variance_ratio(long: DataFrame, lags: int = 2, by: Sequence[str] = KEY) -> DataFrame:
    """Lo-MacKinlay variance ratio of overlapping differences and its heteroskedasticity-robust z."""
    w = ordered(by)
    d = long.where("value IS NOT NULL").withColumn("d", F.col("value") - F.lag("value").over(w)).where("d IS NOT NULL")
    d = d.withColumn("e", F.col("d") - F.avg("d").over(whole(by)))
    q = ordered(by).rowsBetween(-(lags - 1), 0)
    d = d.withColumn("s", F.when(F.count("e").over(q) == lags, F.sum("e").over(q)))
    d = d.withColumns({f"_p{k}": F.pow(F.col("e") * F.lag("e", k).over(w), 2) for k in range(1, lags)})
    den = F.sum(F.col("e") * F.col("e"))
    g = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), den.alias("den"), F.sum(F.col("s") * F.col("s")).alias("ss"),
        *[ratio(F.sum(f"_p{k}"), den * den).alias(f"_t{k}") for k in range(1, lags)],
    )
    n = F.col("n")
    m = lags * (n - lags + 1) * (1 - F.lit(lags) / n)
    vr = (F.col("ss") / m) / (F.col("den") / (n - 1))
    theta = sum((F.col(f"_t{k}") * (2 * (lags - k) / lags) ** 2 for k in range(1, lags)), F.lit(0.0))
    return g.select(*by, "n", vr.alias("variance_ratio"), ((vr - 1) / F.sqrt(F.when(theta > 0, theta))).alias("z"))


def structural_stability(long: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    """OLS-CUSUM of the mean model: sup |sum of residuals| / (s sqrt(n))."""
    e = long.where("value IS NOT NULL").withColumn("e", F.col("value") - F.avg("value").over(whole(by)))
    e = e.withColumn("c", F.sum("e").over(ordered(by).rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy(*by).agg(ratio(F.max(F.abs("c")), F.sqrt(F.sum(F.col("e") * F.col("e")) / (F.count("e") - 1)) * F.sqrt(F.count("e"))).alias("statistic"), F.count("e").alias("n"))


def kpss_statistic(long: DataFrame, nlags: int = 4, by: Sequence[str] = KEY) -> DataFrame:
    """KPSS level statistic with a Bartlett long-run variance."""
    e = long.where("value IS NOT NULL").withColumn("e", F.col("value") - F.avg("value").over(whole(by)))
    w = ordered(by)
    e = e.withColumn("c", F.sum("e").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    e = e.withColumns({f"_p{k}": F.col("e") * F.lag("e", k).over(w) for k in range(1, nlags + 1)})
    n = F.count("e")
    lrv = F.sum(F.col("e") * F.col("e")) / n
    for k in range(1, nlags + 1):
        lrv = lrv + 2 * (1 - k / (nlags + 1)) * F.sum(f"_p{k}") / n
    return e.groupBy(*by).agg(ratio(F.sum(F.col("c") * F.col("c")) / (n * n), lrv).alias("kpss"), n.alias("n"))
