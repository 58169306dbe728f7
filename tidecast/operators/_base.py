"""What the panel operators share.

A panel is a DataFrame with an order column (``date``), any number of key
columns (``by``: series, entity, region) and double columns.  Every window is
partitioned by the keys, so a panel of many series spreads over the cluster; a
panel without keys is one series and is small by nature.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

DATE = "date"
NUMERIC = (T.DoubleType, T.FloatType, T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.DecimalType)


class PanelError(ValueError):
    """The frame breaks the panel contract."""


def ordered(by: Sequence[str] = (), order: str = DATE) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(order)


def whole(by: Sequence[str] = ()) -> WindowSpec:
    return Window.partitionBy(*by)


def trailing(n: int, by: Sequence[str] = (), order: str = DATE, shift: int = 0) -> WindowSpec:
    """The ``n`` rows that end ``shift`` rows before the current one."""
    return ordered(by, order).rowsBetween(-(n - 1) - shift, -shift)


def upto(by: Sequence[str] = (), order: str = DATE, lag: int = 0) -> WindowSpec:
    """All rows up to ``lag`` rows before the current one."""
    return ordered(by, order).rowsBetween(Window.unboundedPreceding, -lag)


def value_columns(df: DataFrame, columns: Sequence[str] | None, by: Sequence[str] = (), order: str = DATE) -> list[str]:
    if columns is not None:
        return list(columns)
    return [f.name for f in df.schema if f.name not in (*by, order) and isinstance(f.dataType, NUMERIC)]


def finite(c: Column) -> Column:
    """NaN and infinities become NULL."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), d)


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, NULL where ``b`` is zero."""
    return F.try_divide(a, b)


def melt(df: DataFrame, columns: Sequence[str], ids: Sequence[str], name: str = "series", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(columns), name, value)
