"""Forecast comparison tests: sufficient statistics in SQL, p-values after aggregation.

Each test returns one row per group.  Statistics come from window lags and
aggregates, so they scale with the forecast table; p-values need distribution
functions that SQL lacks and are added by ``with_p_value`` to the few result rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ._base import ordered, ratio, whole

KEYS = ("target", "horizon", "model")


def with_p_value(df: DataFrame, kind: str, statistic: str = "statistic", df_col: str | None = None, name: str = "p_value") -> DataFrame:
    """kind: normal_two, normal_upper, t_two, chi2 (``df_col`` names the degrees of freedom)."""

    @F.pandas_udf("double")
    def p(x: pd.Series, d: pd.Series) -> pd.Series:
        f = {
            "normal_two": lambda a, b: 2 * float(S.norm_sf(abs(a))), "normal_upper": lambda a, b: float(S.norm_sf(a)),
            "t_two": lambda a, b: S.t_two_sided(a, b), "chi2": lambda a, b: S.chi2_sf(a, b),
        }[kind]
        return pd.Series([np.nan if pd.isna(a) or pd.isna(b) else f(float(a), float(b)) for a, b in zip(x, d)])

    value = p(F.col(statistic).cast("double"), (F.col(df_col) if df_col else F.lit(1)).cast("double"))
    return df.withColumn(name, F.when(~F.isnan(value), value))


def hac_mean(df: DataFrame, column: str, by: Sequence[str], lags: int | Column = 0, kernel: str = "acf", order: str = "date", most: int = 24) -> DataFrame:
    """mean, long-run variance and n of a column per group.

    ``lags`` may differ by group (a column, at most ``most``).  Kernel ``acf``: plain sum of
    autocovariances, back to lag 0 where that is not positive; ``newey_west``: Bartlett 1 - k/(L+1).
    """
    w = whole(by)
    top = lags if isinstance(lags, int) else most
    d = df.where(F.col(column).isNotNull()).withColumn("_d", F.col(column) - F.avg(column).over(w))
    d = d.withColumn("_L", F.lit(lags) if isinstance(lags, int) else lags)
    d = d.withColumns({f"_p{k}": F.col("_d") * F.lag("_d", k).over(ordered(by, order)) for k in range(1, top + 1)})
    g = d.groupBy(*by).agg(
        F.avg(column).alias("mean"), F.count(F.lit(1)).alias("n"), (F.sum(F.col("_d") * F.col("_d")) / F.count(F.lit(1))).alias("_g0"),
        F.max("_L").alias("_L"), *[(F.sum(f"_p{k}") / F.count(F.lit(1))).alias(f"_g{k}") for k in range(1, top + 1)],
    )
    weight = lambda k: F.lit(1.0) if kernel == "acf" else 1 - F.lit(k) / (F.col("_L") + 1)
    total = reduce(
        lambda a, k: a + F.when(F.col("_L") >= k, 2 * weight(k) * F.coalesce(f"_g{k}", F.lit(0.0))).otherwise(0.0), range(1, top + 1), F.col("_g0")
    )
    lrv = F.when((total <= 0) & (F.col("_L") > 0), F.col("_g0")).otherwise(total)
    return g.select(*by, "mean", F.when(lrv > 0, lrv).alias("lrv"), "n")


def loss_differences(forecasts: DataFrame, benchmark: str, loss: str = "squared_error", at_least: int = 8) -> DataFrame:
    """Contender loss less benchmark loss (``d``) on shared dates; groups of fewer than ``at_least`` rows go."""
    from .metrics import compute_point_loss, with_benchmark

    both = with_benchmark(forecasts, benchmark).where(F.col("model") != benchmark)
    d = both.withColumn("d", compute_point_loss(loss) - compute_point_loss(loss, p="benchmark_prediction"))
    return d.withColumn("_n", F.count(F.lit(1)).over(whole(KEYS))).where(F.col("_n") >= at_least).drop("_n")


def dm_statistics(forecasts: DataFrame, benchmark: str, loss: str = "squared_error") -> DataFrame:
    """Diebold-Mariano with lag h - 1 and the small-sample factor; negative: the contender is better."""
    d = loss_differences(forecasts, benchmark, loss)
    g = hac_mean(d, "d", KEYS, F.col("horizon") - 1)
    n, h = F.col("n"), F.col("horizon")
    factor = F.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n)
    return g.select(*KEYS, "n", (F.col("mean") / F.sqrt(F.col("lrv") / n) * factor).alias("statistic"))


def dm_test(forecasts: DataFrame, benchmark: str, loss: str = "squared_error") -> DataFrame:
    return with_p_value(dm_statistics(forecasts, benchmark, loss).withColumn("df", F.col("n") - 1), "t_two", df_col="df").drop("df")


gw_test = dm_test


def clark_west_statistics(forecasts: DataFrame, benchmark: str) -> DataFrame:
    """The benchmark is the small model."""
    d = loss_differences(forecasts, benchmark)
    es, el = F.col("actual") - F.col("benchmark_prediction"), F.col("actual") - F.col("prediction")
    f = es * es - el * el + F.pow(F.col("benchmark_prediction") - F.col("prediction"), 2)
    g = hac_mean(d.withColumn("f", f), "f", KEYS, F.col("horizon") - 1)
    return g.select(*KEYS, "n", (F.col("mean") / F.sqrt(F.col("lrv") / F.col("n"))).alias("statistic"))


def clark_west_test(forecasts: DataFrame, benchmark: str) -> DataFrame:
    return with_p_value(clark_west_statistics(forecasts, benchmark), "normal_upper")


cw_test = clark_west_test


def encompassing_statistics(forecasts: DataFrame, benchmark: str) -> DataFrame:
    """enc_new (no p-value: its distribution is not standard) and enc_t with Bartlett lags h - 1."""
    d = loss_differences(forecasts, benchmark)
    es, el = F.col("actual") - F.col("benchmark_prediction"), F.col("actual") - F.col("prediction")
    d = d.withColumn("c", es * (es - el)).withColumn("el2", el * el)
    new = d.groupBy(*KEYS).agg((F.count(F.lit(1)) * F.avg("c") / F.when(F.avg("el2") > 0, F.avg("el2"))).alias("enc_new"))
    g = hac_mean(d, "c", KEYS, F.col("horizon") - 1, "newey_west")
    return g.join(new, list(KEYS)).select(*KEYS, "n", "enc_new", (F.col("mean") / F.sqrt(F.col("lrv") / F.col("n"))).alias("enc_t"))


enc_new_test = enc_t_test = encompassing_statistics


def harvey_newbold_test(forecasts: DataFrame, benchmark: str) -> DataFrame:
    """t of e1 (e1 - e2) with the small-sample factor."""
    d = loss_differences(forecasts, benchmark)
    e1, e2 = F.col("actual") - F.col("prediction"), F.col("actual") - F.col("benchmark_prediction")
    g = hac_mean(d.withColumn("c", e1 * (e1 - e2)), "c", KEYS, F.col("horizon") - 1, "newey_west")
    n, h = F.col("n"), F.col("horizon")
    s = g.select(*KEYS, "n", (F.col("mean") / F.sqrt(F.col("lrv") / n) * F.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n)).alias("statistic"), (n - 1).alias("df"))
    return with_p_value(s, "t_two", df_col="df").drop("df")


hn_test = harvey_newbold_test


def directional_statistics(forecasts: DataFrame, threshold: float = 0.0, by: Sequence[str] = KEYS) -> DataFrame:
    """Pesaran-Timmermann, Henriksson-Merton and Anatolyev-Gerko statistics of actual and prediction signs."""
    rows = forecasts.where("actual IS NOT NULL AND prediction IS NOT NULL")
    y, x = (F.col("actual") > threshold).cast("double"), (F.col("prediction") > threshold).cast("double")
    sign = F.signum(F.col("prediction") - threshold)
    g = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("py"), F.avg(x).alias("px"), F.avg((y == x).cast("double")).alias("s"),
        F.avg(F.when(y == 1, x)).alias("up"), F.avg(F.when(y == 0, 1 - x)).alias("down"), F.sum(y).alias("n_up"),
        F.avg(sign * F.col("actual")).alias("sy"), F.avg(sign).alias("ms"), F.avg("actual").alias("my"),
        (F.var_pop("actual") * F.count(F.lit(1))).alias("syy"),
    )
    n, py, px = F.col("n"), F.col("py"), F.col("px")
    star = py * px + (1 - py) * (1 - px)
    v = star * (1 - star) / n
    vs = ((2 * py - 1) * (2 * py - 1) * px * (1 - px) + (2 * px - 1) * (2 * px - 1) * py * (1 - py)) / n + 4 * py * px * (1 - py) * (1 - px) / (n * n)
    p = 0.5 * (1 + F.col("ms"))
    var = 4 / (n * n) * p * (1 - p) * F.col("syy")
    safe = lambda d: F.when(d > 1e-15, F.sqrt(F.when(d > 1e-15, d)))
    return g.select(
        *by, "n", ((F.col("s") - star) / safe(v - vs)).alias("pt"),
        ((F.col("up") + F.col("down") - 1) * F.sqrt(F.least(F.col("n_up"), n - F.col("n_up")))).alias("hm"),
        ((F.col("sy") - F.col("ms") * F.col("my")) / safe(var)).alias("ag"),
    )


def directional_accuracy_test(forecasts: DataFrame, method: str = "pesaran_timmermann", **o) -> DataFrame:
    name = {"pesaran_timmermann": "pt", "henriksson_merton": "hm", "anatolyev_gerko": "ag"}[method]
    g = directional_statistics(forecasts, **o)
    keys = [c for c in g.columns if c not in ("n", "pt", "hm", "ag")]
    return with_p_value(g.select(*keys, "n", F.col(name).alias("statistic")), "normal_upper")


def pesaran_timmermann_test(forecasts: DataFrame, **o) -> DataFrame:
    return directional_accuracy_test(forecasts, "pesaran_timmermann", **o)


def henriksson_merton_test(forecasts: DataFrame, **o) -> DataFrame:
    return directional_accuracy_test(forecasts, "henriksson_merton", **o)


def anatolyev_gerko_test(forecasts: DataFrame, **o) -> DataFrame:
    return directional_accuracy_test(forecasts, "anatolyev_gerko", **o)


def mincer_zarnowitz_statistics(forecasts: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """actual = alpha + beta prediction; Wald statistic of (0, 1) with the classical covariance, n - 2 degrees."""
    rows = forecasts.where("actual IS NOT NULL AND prediction IS NOT NULL")
    g = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.regr_intercept("actual", "prediction").alias("alpha"), F.regr_slope("actual", "prediction").alias("beta"),
        F.regr_sxx("actual", "prediction").alias("sxx"), F.regr_syy("actual", "prediction").alias("syy"),
        F.regr_sxy("actual", "prediction").alias("sxy"), F.avg("prediction").alias("mx"),
    )
    n, a, b1 = F.col("n"), F.col("alpha"), F.col("beta") - 1
    s2 = (F.col("syy") - F.col("beta") * F.col("sxy")) / (n - 2)
    # d' X'X d / s2 with d = (alpha, beta - 1)
    quad = n * a * a + 2 * n * F.col("mx") * a * b1 + (F.col("sxx") + n * F.col("mx") * F.col("mx")) * b1 * b1
    return g.where("n > 2 AND sxx > 0").select(*by, "n", "alpha", "beta", (quad / F.when(s2 > 1e-14, s2)).alias("statistic"))


def mincer_zarnowitz_test(forecasts: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    return with_p_value(mincer_zarnowitz_statistics(forecasts, by).withColumn("df", F.lit(2)), "chi2", df_col="df").drop("df")


def interval_coverage_statistics(rows: DataFrame, alpha: float = 0.05, by: Sequence[str] = KEYS) -> DataFrame:
    """Kupiec and Christoffersen likelihood ratios of misses of [lower, upper] at nominal rate ``alpha``."""
    hit = rows.where("actual IS NOT NULL AND lower IS NOT NULL AND upper IS NOT NULL").withColumn("v", (~F.col("actual").between(F.col("lower"), F.col("upper"))).cast("int"))
    hit = hit.withColumn("b", F.lag("v").over(ordered(by)))
    c = lambda i, j: F.count_if((F.col("b") == i) & (F.col("v") == j)).cast("double")
    g = hit.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("v").cast("double").alias("x"), c(0, 0).alias("n00"), c(0, 1).alias("n01"), c(1, 0).alias("n10"), c(1, 1).alias("n11"))
    xlog = lambda k, p: F.when(k > 0, k * F.ln(F.when(p > 0, p))).otherwise(0.0)
    n, x = F.col("n"), F.col("x")
    rate = x / n
    uc = -2 * (xlog(n - x, F.lit(1 - alpha)) + xlog(x, F.lit(alpha)) - xlog(n - x, 1 - rate) - xlog(x, rate))
    n00, n01, n10, n11 = (F.col(f"n{i}") for i in ("00", "01", "10", "11"))
    p01, p11 = F.coalesce(ratio(n01, n00 + n01), F.lit(0.0)), F.coalesce(ratio(n11, n10 + n11), F.lit(0.0))
    p = F.coalesce(ratio(n01 + n11, n00 + n01 + n10 + n11), F.lit(0.0))
    free = xlog(n00, 1 - p01) + xlog(n01, p01) + xlog(n10, 1 - p11) + xlog(n11, p11)
    ind = -2 * (xlog(n00 + n10, 1 - p) + xlog(n01 + n11, p) - free)
    return g.select(*by, "n", rate.alias("miss_rate"), uc.alias("kupiec"), ind.alias("independence"), (uc + ind).alias("conditional"))


def interval_coverage_test(rows: DataFrame, alpha: float = 0.05, by: Sequence[str] = KEYS) -> DataFrame:
    g = interval_coverage_statistics(rows, alpha, by).withColumns({"_1": F.lit(1), "_2": F.lit(2)})
    for c, d in (("kupiec", "_1"), ("independence", "_1"), ("conditional", "_2")):
        g = with_p_value(g, "chi2", c, d, f"{c}_p")
    return g.drop("_1", "_2")


def autocorrelations(df: DataFrame, column: str, by: Sequence[str] = (), max_lag: int = 12, order: str = "date") -> DataFrame:
    """by, lag, acf, n: biased sample autocorrelations."""
    d = df.where(F.col(column).isNotNull()).withColumn("_d", F.col(column) - F.avg(column).over(whole(by)))
    w = ordered(by, order)
    d = d.withColumns({f"_p{k}": F.col("_d") * F.lag("_d", k).over(w) for k in range(1, max_lag + 1)})
    den = F.sum(F.col("_d") * F.col("_d"))
    g = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[ratio(F.sum(f"_p{k}"), den).alias(str(k)) for k in range(1, max_lag + 1)])
    return g.unpivot([*by, "n"], [str(k) for k in range(1, max_lag + 1)], "lag", "acf").withColumn("lag", F.col("lag").cast("int"))


def residual_statistics(df: DataFrame, column: str, by: Sequence[str] = (), lags: int = 4, order: str = "date") -> DataFrame:
    """Ljung-Box Q, ARCH Q on squares, Jarque-Bera (with its p-value) and Durbin-Watson per group."""
    a = autocorrelations(df, column, by, lags, order).groupBy(*by, "n").agg((F.sum(F.pow("acf", 2) / (F.col("n") - F.col("lag"))) * F.col("n") * (F.col("n") + 2)).alias("ljung_box"))
    sq = df.withColumn("_sq", F.pow(F.col(column) - F.avg(column).over(whole(by)), 2))
    b = autocorrelations(sq, "_sq", by, lags, order).groupBy(*by, "n").agg((F.sum(F.pow("acf", 2) / (F.col("n") - F.col("lag"))) * F.col("n") * (F.col("n") + 2)).alias("mcleod_li"))
    e = F.col(column)
    d = df.where(e.isNotNull()).withColumn("_diff", e - F.lag(column).over(ordered(by, order)))
    jb = F.count(e) / 6 * (F.pow(F.skewness(e), 2) + F.pow(F.kurtosis(e), 2) / 4)
    c = d.groupBy(*by).agg(jb.alias("jarque_bera"), ratio(F.sum(F.col("_diff") * F.col("_diff")), F.sum(e * e)).alias("durbin_watson"))
    c = c.withColumn("jarque_bera_p", F.exp(-F.col("jarque_bera") / 2))
    if not by:
        return a.select("n", "ljung_box").crossJoin(b.select("mcleod_li")).crossJoin(c)  # one row each
    return a.join(b.drop("n"), list(by)).join(c, list(by))


residual_diagnostics = jarque_bera_test = residual_statistics


def pit_histogram(pit: DataFrame, column: str = "pit", n_bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Counts of all bins (empty ones too) with the uniform expectation."""
    rows = pit.where(F.col(column).isNotNull()).withColumn("bin", F.least(F.floor(F.col(column) * n_bins), F.lit(n_bins - 1)).cast("int"))
    counts = rows.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    total = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("total"))
    grid = total.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
    out = grid.join(counts, [*by, "bin"], "left")
    return out.select(*by, "bin", F.coalesce("n", F.lit(0)).alias("n"), (F.col("total") / n_bins).alias("expected"))


def pit_autocorrelation_test(pit: DataFrame, column: str = "pit", lag: int = 1, by: Sequence[str] = ()) -> DataFrame:
    a = autocorrelations(pit, column, by, lag).where(F.col("lag") == lag)
    return with_p_value(a.withColumn("statistic", F.col("acf") * F.sqrt("n")), "normal_two")


def fluctuation_statistics(forecasts: DataFrame, benchmark: str, window: int, loss: str = "squared_error") -> DataFrame:
    """Giacomini-Rossi: sup over windows of sqrt(m) * mean(d) over the full-sample HAC deviation (uncentred, n - 1)."""
    d = loss_differences(forecasts, benchmark, loss)
    w = ordered(KEYS).rowsBetween(-(window - 1), 0)
    d = d.withColumn("_m", F.when(F.count("d").over(w) == window, F.avg("d").over(w)))
    g = d.groupBy(*KEYS).agg(F.max(F.abs("_m")).alias("top"), (F.sum(F.col("d") * F.col("d")) / (F.count("d") - 1)).alias("v"), F.count("d").alias("n"))
    return g.select(*KEYS, "n", (F.sqrt(F.lit(float(window))) * F.col("top") / F.sqrt(F.when(F.col("v") > 0, F.col("v")))).alias("statistic"))


conditional_predictive_ability_test = fluctuation_statistics


def adjust_pvalues(pvalues: DataFrame, method: str = "bh", p: str = "p_value", by: Sequence[str] = ()) -> DataFrame:
    """bonferroni, holm (step-down) or bh (step-up); missing p-values stay missing and do not count."""
    has = F.col(p).isNotNull()
    w = Window.partitionBy(*by)
    n = F.count(p).over(w)
    out = pvalues.withColumns({"_n": n, "_i": F.row_number().over(w.orderBy(F.col(p).asc_nulls_last()))})
    if method == "bonferroni":
        value = F.col(p) * F.col("_n")
    elif method == "holm":
        value = F.max((F.col("_n") - F.col("_i") + 1) * F.col(p)).over(w.orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))
    elif method == "bh":
        value = F.min(F.col("_n") / F.col("_i") * F.col(p)).over(w.orderBy("_i").rowsBetween(0, Window.unboundedFollowing))
    else:
        raise ValueError(f"unknown method {method}")
    return out.withColumn("p_adjusted", F.when(has, F.least(value, F.lit(1.0)))).drop("_n", "_i")


# Bootstrap tests: one kernel per (target, horizon) on the wide loss panel.


def _block_ids(n: int, block: int, rng: np.random.Generator, stationary: bool = False) -> np.ndarray:
    if stationary:
        jump = rng.random(n) < 1 / block
        jump[0] = True
        start = np.where(jump, rng.integers(0, n, n), 0)
        last = np.maximum.accumulate(np.where(jump, np.arange(n), 0))
        return (start[last] + np.arange(n) - last) % n
    starts = rng.integers(0, n, -(-n // block))
    return ((starts[:, None] + np.arange(block)) % n).reshape(-1)[:n]


def model_confidence_set_kernel(losses: np.ndarray, n_boot: int, block: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Cumulative p-value of each model and the round in which it left (T-max, fixed blocks)."""
    n, m = losses.shape
    rng = np.random.default_rng(seed)
    ids = np.stack([_block_ids(n, block, rng) for _ in range(n_boot)])
    mean, boot = losses.mean(0), losses[ids].mean(1)
    alive, p, out, top = list(range(m)), np.ones(m), np.full(m, m), 0.0
    for step in range(m - 1):
        d = mean[alive] - mean[alive].mean()
        db = boot[:, alive] - boot[:, alive].mean(1, keepdims=True) - d
        s = np.sqrt(np.maximum((db**2).mean(0), 1e-300))
        t, tb = d / s, (db / s).max(1)
        worst = int(np.argmax(t))
        top = max(top, float((tb >= t[worst]).mean()))
        p[alive[worst]], out[alive[worst]] = top, step
        alive.pop(worst)
    return p, out


def spa_kernel(losses: np.ndarray, base: int, n_boot: int, block: int, seed: int) -> tuple[float, float]:
    """p-values of the superior predictive ability test (consistent) and of the reality check."""
    others = [j for j in range(losses.shape[1]) if j != base]
    d = losses[:, [base]] - losses[:, others]
    n = len(d)
    rng = np.random.default_rng(seed)
    ids = np.stack([_block_ids(n, block, rng, True) for _ in range(n_boot)])
    mean, boot = d.mean(0), d[ids].mean(1)
    s = np.sqrt(np.maximum(n * ((boot - mean) ** 2).mean(0), 1e-300))
    keep = np.where(np.sqrt(n) * mean / s >= -np.sqrt(2 * np.log(np.log(max(n, 3)))), mean, 0)
    stat = max(0.0, float((np.sqrt(n) * mean / s).max()))
    spa = float((np.maximum((np.sqrt(n) * (boot - keep) / s).max(1), 0) >= stat).mean())
    rc = float(((np.sqrt(n) * (boot - mean)).max(1) >= float((np.sqrt(n) * mean).max())).mean())
    return spa, rc


def _per_panel(forecasts: DataFrame, func: Callable[[np.ndarray, list[str]], pd.DataFrame], schema: str, loss: str) -> DataFrame:
    from .metrics import compute_point_loss

    rows = forecasts.withColumn("_l", compute_point_loss(loss)).where("_l IS NOT NULL").select("target", "horizon", "date", "model", "_l")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="date", columns="model", values="_l").dropna().sort_index()
        out = func(wide.to_numpy(), list(wide.columns)) if len(wide) >= 8 else pd.DataFrame()
        out = out if len(out) else pd.DataFrame(columns=[x.split()[0] for x in schema.split(", ")[2:]])
        out.insert(0, "target", pdf["target"].iloc[0])
        out.insert(1, "horizon", pdf["horizon"].iloc[0])
        return out

    return rows.groupBy("target", "horizon").applyInPandas(one, schema)


def model_confidence_set(forecasts: DataFrame, alpha: float = 0.1, n_boot: int = 499, block_length: int = 4, seed: int = 0, loss: str = "squared_error") -> DataFrame:
    """target, horizon, model, p_value, in_set; on dates all models share."""

    def run(x: np.ndarray, names: list[str]) -> pd.DataFrame:
        p, _ = model_confidence_set_kernel(x, n_boot, block_length, seed)
        return pd.DataFrame({"model": names, "p_value": p, "in_set": p >= alpha})

    return _per_panel(forecasts, run, "target string, horizon int, model string, p_value double, in_set boolean", loss)


iterative_model_confidence_set = model_confidence_set


def superior_predictive_ability_test(forecasts: DataFrame, benchmark: str, n_boot: int = 499, block_length: int = 4, seed: int = 0, loss: str = "squared_error") -> DataFrame:
    """target, horizon, spa_p, rc_p: no model beats the benchmark."""

    def run(x: np.ndarray, names: list[str]) -> pd.DataFrame:
        spa, rc = spa_kernel(x, names.index(benchmark), n_boot, block_length, seed)
        return pd.DataFrame({"spa_p": [spa], "rc_p": [rc]})

    return _per_panel(forecasts, run, "target string, horizon int, spa_p double, rc_p double", loss)


reality_check_test = superior_predictive_ability_test


def stepm_test(forecasts: DataFrame, benchmark: str, alpha: float = 0.05, n_boot: int = 499, block_length: int = 4, seed: int = 0, loss: str = "squared_error") -> DataFrame:
    """target, horizon, model, rejected: step-down search for models that beat the benchmark."""

    def run(x: np.ndarray, names: list[str]) -> pd.DataFrame:
        base = names.index(benchmark)
        others = [j for j in range(len(names)) if j != base]
        d = x[:, [base]] - x[:, others]
        rng = np.random.default_rng(seed)
        ids = np.stack([_block_ids(len(d), block_length, rng, True) for _ in range(n_boot)])
        mean, boot = d.mean(0), d[ids].mean(1)
        s = np.sqrt(np.maximum(((boot - mean) ** 2).mean(0), 1e-300))
        alive, rejected = np.ones(len(others), bool), np.zeros(len(others), bool)
        while alive.any():
            cut = np.quantile(((boot - mean) / s)[:, alive].max(1), 1 - alpha)
            new = alive & (mean / s > cut)
            if not new.any():
                break
            rejected |= new
            alive &= ~new
        return pd.DataFrame({"model": [names[j] for j in others], "rejected": rejected})

    return _per_panel(forecasts, run, "target string, horizon int, model string, rejected boolean", loss)
