"""Tests over several horizons, tail tests of probability transforms, stacks of tests, residual tests of vector models."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import structural, tests_stat
from ._base import ratio
from .tests_stat import KEYS, hac_mean, loss_differences, with_p_value


@dataclass(frozen=True)
class TestResult:
    """One outcome, for functions that test one sample."""

    __test__ = False
    statistic: float | None
    p_value: float | None
    decision: bool
    alternative: str = "two_sided"
    n_obs: int = 0
    metadata: dict[str, object] = field(default_factory=dict)

    def summary(self) -> dict[str, object]:
        return {"statistic": self.statistic, "p_value": self.p_value, "decision": self.decision, "n_obs": self.n_obs, **self.metadata}

    to_dict = summary


def custom_test(name: str, func: Callable[..., tuple[float, float]], *samples: np.ndarray, alpha: float = 0.05, **params) -> TestResult:
    """``func(*samples, **params)`` gives statistic and p-value."""
    statistic, p = func(*samples, **params)
    return TestResult(float(statistic), float(p), bool(p < alpha), n_obs=len(samples[0]) if samples else 0, metadata={"test": name})


def dmp_statistics(forecasts: DataFrame, benchmark: str, loss: str = "squared_error", kernel: str = "newey_west") -> DataFrame:
    """target, model, n, statistic: mean loss difference of all horizons stacked, with a HAC deviation of n^(1/3) lags.

    Horizons follow each other in the stack, so lags run on from the end of one into the next.
    """
    d = loss_differences(forecasts, benchmark, loss).withColumn("order", F.struct("horizon", "date"))
    lags = F.least(F.floor(F.pow(F.col("_n"), 1 / 3)), F.col("_n") - 1)
    d = d.withColumn("_n", F.count(F.lit(1)).over(tests_stat.whole(("target", "model"))))
    g = hac_mean(d, "d", ("target", "model"), lags.cast("int"), kernel, "order", 8)
    return g.select("target", "model", "n", (F.col("mean") / F.sqrt(F.col("lrv") / F.col("n"))).alias("statistic"))


def dmp_test(forecasts: DataFrame, benchmark: str, **o) -> DataFrame:
    return with_p_value(dmp_statistics(forecasts, benchmark, **o), "normal_two")


def equal_predictive_tests(forecasts: DataFrame, benchmark: str, tests: Sequence[str] = ("dm", "gw", "dmp")) -> DataFrame:
    """test, target, horizon (null for joint tests), model, n, statistic, p_value."""
    made = {"dm": tests_stat.dm_test, "gw": tests_stat.gw_test, "dmp": dmp_test}
    parts = [made[t](forecasts, benchmark).withColumn("test", F.lit(t)) for t in tests]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def nested_tests(forecasts: DataFrame, benchmark: str, tests: Sequence[str] = ("cw", "enc_new", "enc_t")) -> DataFrame:
    """The benchmark is the small model; ENC-NEW has no standard p-value."""
    enc = tests_stat.encompassing_statistics(forecasts, benchmark)
    made = {
        "cw": lambda: tests_stat.clark_west_test(forecasts, benchmark), "enc_t": lambda: with_p_value(enc.select(*KEYS, "n", F.col("enc_t").alias("statistic")), "normal_upper"),
        "enc_new": lambda: enc.select(*KEYS, "n", F.col("enc_new").alias("statistic"), F.lit(None).cast("double").alias("p_value")),
    }
    return reduce(DataFrame.unionByName, [made[t]().withColumn("test", F.lit(t)) for t in tests])


def shortfall_de_statistics(pit: DataFrame, alpha: float = 0.05, lags: int = 1, column: str = "pit", by: Sequence[str] = KEYS) -> DataFrame:
    """Tail shortfall of probability transforms: its mean, z against alpha / 2, and a portmanteau of its first ``lags`` autocorrelations."""
    u, w = F.col(column), tests_stat.ordered(by)
    rows = pit.where(u.isNotNull()).withColumn("_s", F.when(u <= alpha, (alpha - u) / alpha).otherwise(0.0))
    rows = rows.withColumn("_a", F.col("_s") - alpha / 2)
    rows = rows.withColumns({f"_p{k}": F.col("_a") * F.lag("_a", k).over(w) for k in range(1, lags + 1)})
    n, spread = F.count(F.lit(1)), float(np.sqrt(alpha * (1 / 3 - alpha / 4)))
    g = rows.groupBy(*by).agg(n.alias("n"), F.avg("_s").alias("mean"), F.avg(F.col("_a") * F.col("_a")).alias("_v"), *[F.sum(f"_p{k}").alias(f"_c{k}") for k in range(1, lags + 1)])
    total = reduce(lambda a, k: a + F.pow(ratio(F.col(f"_c{k}") / F.when(F.col("n") > k, F.col("n") - k), F.col("_v")), 2), range(1, lags + 1), F.lit(0.0))
    return g.select(*by, "n", "mean", (F.sqrt("n") * (F.col("mean") - alpha / 2) / spread).alias("unconditional"), (F.col("n") * total).alias("conditional"))


def shortfall_de_test(pit: DataFrame, alpha: float = 0.05, lags: int = 1, column: str = "pit", by: Sequence[str] = KEYS, boot: bool = False, n_boot: int = 2000, random_state: int = 0) -> DataFrame:
    """Both statistics with p-values: normal and chi-square, or from uniform samples of the same size."""
    g = shortfall_de_statistics(pit, alpha, lags, column, by)
    if not boot:
        g = with_p_value(g.withColumn("_df", F.lit(lags)), "normal_two", "unconditional", name="unconditional_p")
        return with_p_value(g, "chi2", "conditional", "_df", "conditional_p").drop("_df")

    def simulated(n: int) -> tuple[np.ndarray, np.ndarray]:
        u = np.random.default_rng([random_state, n]).random((n_boot, n))
        s = np.where(u <= alpha, (alpha - u) / alpha, 0.0)
        a = s - alpha / 2
        c = sum(((a[:, k:] * a[:, : n - k]).sum(1) / (n - k) / (a**2).mean(1)) ** 2 for k in range(1, lags + 1))
        return s.mean(1), n * c

    @F.pandas_udf("struct<u: double, c: double>")
    def p(n: pd.Series, mean: pd.Series, conditional: pd.Series) -> pd.DataFrame:
        out, drawn = [], {}
        for k, m, c in zip(n, mean, conditional):
            if int(k) not in drawn:
                drawn[int(k)] = simulated(int(k))
            means, cs = drawn[int(k)]
            out.append((min(1.0, 2 * min((means <= m).mean(), (means >= m).mean())), np.nan if pd.isna(c) else float((cs >= c).mean())))
        return pd.DataFrame(out, columns=["u", "c"])

    return g.withColumn("_p", p("n", "mean", "conditional")).withColumns({"unconditional_p": F.col("_p.u"), "conditional_p": F.col("_p.c")}).drop("_p")


def blocked_oob_reality_check(forecasts: DataFrame, benchmark: str, alpha: float = 0.05, n_boot: int = 999, block_length: int = 4, seed: int = 0, loss: str = "squared_error") -> DataFrame:
    """target, horizon, model, mean_diff (positive: better than the benchmark), statistic, p_value, familywise_p_value, decision.

    Blocks are drawn with replacement; the familywise p-value holds a gain against the greatest centred one of all models.
    """

    def run(x: np.ndarray, names: list[str]) -> pd.DataFrame:
        base = names.index(benchmark)
        others = [j for j in range(len(names)) if j != base]
        d = x[:, [base]] - x[:, others]
        rng = np.random.default_rng(seed)
        ids = np.stack([tests_stat._block_ids(len(d), block_length, rng) for _ in range(n_boot)])
        mean, boot = d.mean(0), (d - d.mean(0))[ids].mean(1)
        p = (boot >= mean).mean(0)
        family = (boot.max(1)[:, None] >= mean).mean(0)
        return pd.DataFrame({"model": [names[j] for j in others], "mean_diff": mean, "statistic": mean / np.maximum(boot.std(0, ddof=1), 1e-12), "p_value": p, "familywise_p_value": family, "decision": p < alpha})

    schema = "target string, horizon int, model string, mean_diff double, statistic double, p_value double, familywise_p_value double, decision boolean"
    return tests_stat._per_panel(forecasts, run, schema, loss)


_VAR = {"serial": structural.var_serial_test, "normality": structural.var_normality_test, "arch": structural.var_arch_test}


def var_residual_tests(panel: DataFrame, columns: Sequence[str], n_lag: int = 1, tests: Sequence[str] = ("serial", "normality", "arch"), by: Sequence[str] = (), **o) -> DataFrame:
    """by, test, statistic, p_value, df of a vector autoregression's residuals, one panel a group."""
    kinds = {f.name: f.dataType.simpleString() for f in panel.schema}

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        z = pdf.sort_values("date")[list(columns)].dropna().to_numpy(float)
        rows = [{**{k: pdf[k].iloc[0] for k in by}, "test": t, **_VAR[t](z, n_lag, **o)} for t in tests]
        return pd.DataFrame(rows)[[*by, "test", "statistic", "p_value", "df"]]

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in by), "test string, statistic double, p_value double, df long"])
    return panel.select(*by, "date", *columns).groupBy(*by).applyInPandas(one, schema)


def var_serial_test(panel: DataFrame, columns: Sequence[str], **o) -> DataFrame:
    return var_residual_tests(panel, columns, tests=("serial",), **o)


def var_normality_test(panel: DataFrame, columns: Sequence[str], **o) -> DataFrame:
    return var_residual_tests(panel, columns, tests=("normality",), **o)


def var_arch_test(panel: DataFrame, columns: Sequence[str], **o) -> DataFrame:
    return var_residual_tests(panel, columns, tests=("arch",), **o)
