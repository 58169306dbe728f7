"""Forecast origins, validation folds and stage scopes as tables of row positions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import DATE, ordered


def positions(panel: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``panel`` with ``pos``, counted from 0 per key."""
    return panel.withColumn("pos", F.row_number().over(ordered(by)) - 1)


@dataclass(frozen=True)
class EstimationWindow:
    mode: str = "expanding"  # expanding, rolling, fixed
    size: int | None = None
    start: int = 0
    end: int | None = None
    min_size: int = 1
    embargo: int = 0
    retrain_every: int = 1


@dataclass(frozen=True)
class ValWindow:
    method: str = "last_block"
    options: tuple[tuple[str, object], ...] = ()
    retune_every: int = 1
    retune_on_retrain: bool = True


@dataclass(frozen=True)
class TestWindow:
    __test__ = False
    first_origin: int | None = None
    last_origin: int | None = None
    horizon: int = 1
    step: int = 1
    drop_incomplete: bool = True


@dataclass(frozen=True)
class AlignmentWindow:
    """How features and targets meet: on shared dates with complete rows, or on all dates."""

    mode: str = "drop_incomplete"  # drop_incomplete, keep_missing
    join: str = "inner"  # inner, full
    require_full_horizon: bool = True

    def align(self, x: DataFrame, y: DataFrame) -> DataFrame:
        out = x.join(y, DATE, self.join)
        out = out.dropna("any") if self.mode == "drop_incomplete" else out
        targets = [c for c in y.columns if c != DATE]
        return out.dropna("any", subset=targets) if self.require_full_horizon and targets else out


def alignment_drop_incomplete(join: str = "inner", require_full_horizon: bool = True) -> AlignmentWindow:
    return AlignmentWindow("drop_incomplete", join, require_full_horizon)


def alignment_keep_missing(join: str = "inner", require_full_horizon: bool = True) -> AlignmentWindow:
    return AlignmentWindow("keep_missing", join, require_full_horizon)


#: Other names of windows.
_WINDOW_NAMES = {"recursive": "expanding", "growing": "expanding", "moving": "rolling", "sliding": "rolling", "constant": "fixed"}


def normalize_window_name(window: str) -> str:
    name = window.strip().lower().replace("-", "_")
    name = _WINDOW_NAMES.get(name, name)
    if name not in ("expanding", "rolling", "fixed"):
        raise ValueError(f"unknown window {window}")
    return name


@dataclass(frozen=True)
class WindowSpec:
    estimation: EstimationWindow = EstimationWindow()
    val: ValWindow = ValWindow()
    test: TestWindow = TestWindow()
    alignment: AlignmentWindow = AlignmentWindow()

    def origins(self, spark: SparkSession, n: int) -> DataFrame:
        return origins(spark, n, self)


def spec(estimation: EstimationWindow | None = None, val: ValWindow | None = None, test: TestWindow | None = None) -> WindowSpec:
    return WindowSpec(estimation or EstimationWindow(), val or ValWindow(), test or TestWindow())


def estimation_expanding(**o) -> EstimationWindow:
    return EstimationWindow("expanding", **o)


def estimation_rolling(size: int, **o) -> EstimationWindow:
    return EstimationWindow("rolling", size=size, **o)


def estimation_fixed(end: int, **o) -> EstimationWindow:
    return EstimationWindow("fixed", end=end, **o)


def test_origins(**o) -> TestWindow:
    return TestWindow(**o)


test_origins.__test__ = False


def _val(method: str) -> Callable[..., ValWindow]:
    def build(retune_every: int = 1, retune_on_retrain: bool = True, **options: object) -> ValWindow:
        return ValWindow(method, tuple(options.items()), retune_every, retune_on_retrain)

    return build


val_last_block, val_poos, val_expanding = _val("last_block"), _val("poos"), _val("expanding")
val_rolling_blocks, val_blocked_kfold, val_random_kfold = _val("rolling_blocks"), _val("blocked_kfold"), _val("random_kfold")


def origins(spark: SparkSession, n: int, window: WindowSpec) -> DataFrame:
    """One row per origin: fit and test positions, retrain and retune flags.

    Fit ends ``embargo`` rows before the row ahead of the origin; the test slice starts at the origin.
    """
    e, t = window.estimation, window.test
    first = t.first_origin if t.first_origin is not None else e.start + e.min_size + e.embargo
    last = t.last_origin if t.last_origin is not None else n - 1
    at = spark.range(first, last + 1, t.step).select(F.col("id").cast("int").alias("origin_pos"))
    end = F.col("origin_pos") - 1 - e.embargo
    start = F.lit(e.start)
    if e.mode == "rolling":
        start = F.greatest(F.lit(e.start), end - (e.size - 1))
    elif e.mode == "fixed":
        end = F.lit(e.end)
    nth = ((F.col("origin_pos") - first) / t.step).cast("int")
    retrain = nth % e.retrain_every == 0
    retune = nth % window.val.retune_every == 0
    out = at.select(
        "origin_pos", start.cast("int").alias("fit_start"), end.cast("int").alias("fit_end"),
        F.col("origin_pos").alias("test_start"), (F.col("origin_pos") + t.horizon - 1).cast("int").alias("test_end"),
        retrain.alias("retrain"), (retune & retrain if window.val.retune_on_retrain else retune).alias("retune"),
    )
    out = out.where(F.col("fit_end") - F.col("fit_start") + 1 >= e.min_size)
    return out.where(F.col("test_end") < n) if t.drop_incomplete else out


def from_cutoffs(panel: DataFrame, test_start: str, test_end: str | None = None, mode: str = "expanding", size: int | None = None, horizon: int = 1) -> WindowSpec:
    """Calendar cutoffs to positions (one aggregate row)."""
    p = positions(panel)
    d = F.col(DATE)
    found = p.agg(
        F.min(F.when(d >= F.lit(test_start).cast("date"), F.col("pos"))).alias("a"),
        F.max(F.when(d <= F.lit(test_end).cast("date") if test_end else F.lit(True), F.col("pos"))).alias("b"),
    ).first()
    return WindowSpec(EstimationWindow(mode, size=size), ValWindow(), TestWindow(found["a"], found["b"], horizon))


# Folds: lists of (train_start, train_end, val_start, val_end), ends exclusive.

Fold = tuple[int, int, int, int]


def last_block_split(n: int, validation_size: int | None = None, validation_ratio: float = 0.2, embargo: int = 0) -> list[Fold]:
    size = validation_size or max(1, int(n * validation_ratio))
    return [(0, n - size - embargo, n - size, n)]


def poos_split(n: int, validation_size: int | None = None, validation_ratio: float = 0.25, embargo: int = 0) -> list[Fold]:
    size = validation_size or max(1, int(n * validation_ratio))
    return [(0, i - embargo, i, i + 1) for i in range(n - size, n) if i - embargo > 0]


def expanding_split(n: int, min_train_size: int | None = None, step: int = 1, horizon: int = 1, embargo: int = 0) -> list[Fold]:
    least = n // 2 if min_train_size is None else min_train_size
    return [(0, i, i + embargo, i + embargo + horizon) for i in range(least, n - embargo - horizon + 1, step)]


def rolling_blocks_split(n: int, n_blocks: int = 3, block_size: int | None = None, embargo: int = 0) -> list[Fold]:
    size = block_size or max(1, n // (n_blocks + 2))
    first = n - n_blocks * size
    return [(0, first + b * size - embargo, first + b * size, first + (b + 1) * size) for b in range(n_blocks) if first + b * size - embargo > 0]


def blocked_kfold_split(n: int, n_splits: int = 5, embargo: int = 0) -> list[Fold]:
    cuts = [i * n // n_splits for i in range(n_splits + 1)]
    return [(0, a - embargo, a, b) for a, b in zip(cuts, cuts[1:]) if a - embargo > 0]


def random_kfold_split(n: int, n_splits: int = 5, random_state: int = 0) -> list[tuple[list[int], list[int]]]:
    import numpy as np

    part = np.random.default_rng(random_state).permutation(n) % n_splits
    return [(np.flatnonzero(part != k).tolist(), np.flatnonzero(part == k).tolist()) for k in range(n_splits)]


SPLITTERS: dict[str, Callable[..., list]] = {
    "last_block": last_block_split, "poos": poos_split, "expanding": expanding_split, "rolling_blocks": rolling_blocks_split,
    "blocked_kfold": blocked_kfold_split, "random_kfold": random_kfold_split,
}


def make_splitter(validation: str, n: int, **options) -> list:
    return SPLITTERS[validation](n, **options)


def split_table(spark: SparkSession, validation: str, n: int, **options) -> DataFrame:
    """fold and its bounds (interval splitters only)."""
    folds = [(i, *f) for i, f in enumerate(make_splitter(validation, n, **options))]
    return spark.createDataFrame(folds, "fold int, train_start int, train_end int, val_start int, val_end int")


def resolve_window(window: WindowSpec | EstimationWindow | str | None = None) -> WindowSpec:
    """A specification from one, an estimation window, its name, or nothing."""
    if isinstance(window, WindowSpec):
        return window
    if isinstance(window, str):
        return WindowSpec(EstimationWindow(normalize_window_name(window)))
    return WindowSpec(window or EstimationWindow())


@dataclass(frozen=True)
class StagePolicy:
    scope: str = "fit_window"  # fit_window, estimation, origin_available, full_panel, fixed_reference
    update: str = "every_origin"  # every_origin, never, on_retrain, every_k
    every: int = 1
    reference: tuple[str, str] | None = None
    selector: Callable[[Column, Column], Column] | None = None  # (row position, origin position) to a condition


SCOPES = ("fit_window", "estimation", "origin_available", "full_panel", "fixed_reference", "custom")


def custom_stage_policy(selector: Callable[[Column, Column], Column], update: str = "every_origin", **o) -> StagePolicy:
    """Rows for which ``selector(pos, origin_pos)`` holds; it is a column expression, so the plan stays one join."""
    return StagePolicy("custom", update, selector=selector, **o)


def resolve_stage_policy(policy: StagePolicy | str | None, default_scope: str = "fit_window") -> StagePolicy:
    out = policy if isinstance(policy, StagePolicy) else StagePolicy(policy or default_scope)
    if out.scope not in SCOPES:
        raise ValueError(f"unknown scope {out.scope}")
    return out


def stage_policy(scope: str = "fit_window", **o) -> StagePolicy:
    return StagePolicy(scope, **o)


def stage_panel(panel: DataFrame, origin_table: DataFrame, policy: StagePolicy) -> DataFrame:
    """origin_pos with the panel rows its stage may see.

    Rows and origins meet by a range of positions.  Each panel row is repeated
    once per origin that sees it, which is what the result holds.
    """
    rows = positions(panel)
    o = origin_table.select("origin_pos", "fit_start", "fit_end")
    allowed = {
        "fit_window": F.col("pos").between(F.col("fit_start"), F.col("fit_end")),
        "estimation": F.col("pos") <= F.col("fit_end"),
        "origin_available": F.col("pos") <= F.col("origin_pos"),
        "full_panel": F.lit(True),
    }
    if policy.scope == "custom":
        allowed["custom"] = policy.selector(F.col("pos"), F.col("origin_pos"))
    if policy.scope == "fixed_reference":
        a, b = policy.reference
        return rows.where(F.col(DATE).between(F.lit(a).cast("date"), F.lit(b).cast("date"))).crossJoin(F.broadcast(o.select("origin_pos")))
    return rows.join(o, allowed[policy.scope]).drop("fit_start", "fit_end")


def stage_updates(origin_table: DataFrame, policy: StagePolicy) -> DataFrame:
    """``origin_table`` with stage_fit: the origin at which the state in use was last fitted."""
    w = ordered((), "origin_pos")
    nth = F.row_number().over(w) - 1
    due = {"every_origin": F.lit(True), "never": nth == 0, "on_retrain": F.col("retrain") | (nth == 0), "every_k": nth % policy.every == 0}[policy.update]
    return origin_table.withColumn("stage_fit", F.last(F.when(due, F.col("origin_pos")), True).over(w))
