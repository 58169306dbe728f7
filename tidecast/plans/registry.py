"""Queries by name and, where SQL can express them, the SQL that must agree.

Doubles are rounded to six places on both sides, as sums differ in the last bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
DIGITS = 6


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places; minus zero becomes zero."""
    return df.select(*[(F.round(c, DIGITS) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None, doubles: str = ""):
    """Register a query; ``doubles`` names the columns of ``sql`` that are rounded."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            swap = ", ".join(f"round(CAST({c} AS DOUBLE), {DIGITS}) + 0.0 AS {c}" for c in doubles.split())
            ORACLE_SQL[name] = f"SELECT * REPLACE ({swap}) FROM ({sql})" if swap else sql
        return f

    return put


def _load() -> None:
    from . import detail_queries, evaluation_queries, model_queries, panel_queries, study_queries  # noqa: F401


_load()
