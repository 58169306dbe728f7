"""Execution defaults, study digests and a store of finished cells."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class MetaConfig:
    random_seed: int = 0
    n_jobs: int | None = None  # None: what the session has
    on_error: str = "row"  # row: failures become rows; raise
    verbose: bool = False


_held = [MetaConfig()]


def get_config() -> MetaConfig:
    return _held[-1]


def get_option(name: str):
    return getattr(get_config(), name)


def configure(**options) -> MetaConfig:
    _held[-1] = replace(_held[-1], **options)
    return _held[-1]


def reset_config() -> MetaConfig:
    _held[:] = [MetaConfig()]
    return _held[-1]


@contextmanager
def use_config(**options) -> Iterator[MetaConfig]:
    _held.append(replace(_held[-1], **options))
    try:
        yield _held[-1]
    finally:
        _held.pop()


def resolve_n_jobs(spark: SparkSession) -> int:
    return get_option("n_jobs") or spark.sparkContext.defaultParallelism


def cell_digest(arm: object, target: str, horizon: int, data_identity: str) -> str:
    """Identity of a study cell: what is fitted, on what."""
    said = {"arm": asdict(arm) if hasattr(arm, "__dataclass_fields__") else arm, "target": target, "horizon": horizon, "data": data_identity}
    return hashlib.sha256(json.dumps(said, sort_keys=True, default=str).encode()).hexdigest()


class ResultStore:
    """Finished cells as Parquet partitioned by digest; what is not there is still to do."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, master: DataFrame, digest: str, info: Mapping[str, object]) -> None:
        rows = master.withColumns({"digest": F.lit(digest), "info": F.lit(json.dumps(dict(info), default=str))})
        rows.write.mode("append").partitionBy("digest").parquet(self.path)

    def load(self, digest: str) -> DataFrame:
        return self.spark.read.parquet(self.path).where(F.col("digest") == digest).drop("digest", "info")

    def summary(self) -> DataFrame:
        return self.spark.read.parquet(self.path).groupBy("digest", "info").agg(F.count(F.lit(1)).alias("n_rows"))

    def pending(self, cells: DataFrame) -> DataFrame:
        """``cells`` (digest, ...) that are not stored."""
        return cells.join(self.spark.read.parquet(self.path).select("digest").distinct(), "digest", "left_anti")
