"""The panels the registered queries run on, in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.forecasters import window_forecasts


#: About a million, but prime, so that sums of cents are never ties at six places.
SCALE = 999983.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series (supplier), date (month), value (millions shipped, with gaps)."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("series"), F.trunc(F.col("l_shipdate"), "month").alias("date"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"), "l_suppkey",
    )
    g = rows.groupBy("series", "date", "l_suppkey").agg((F.sum("v") / SCALE).alias("v"))
    gap = (F.year("date") * 12 + F.month("date") + F.col("l_suppkey") * 7) % 11 == 0
    return g.select("series", "date", F.when(~gap, F.col("v")).alias("value"))


SHIP_SQL = """panel AS (
  SELECT series, date, CASE WHEN (year(date) * 12 + month(date) + k * 7) % 11 <> 0 THEN v END AS value FROM (
    SELECT 's' || l_suppkey AS series, l_suppkey AS k, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
      sum(l_extendedprice * (1 - l_discount)) / 999983.0 AS v
    FROM lineitem GROUP BY 1, 2, 3))"""


def order_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date (month), p1..p5: millions ordered by priority."""
    rows = table(spark, sf_dir, "orders")
    return rows.groupBy(F.trunc("o_orderdate", "month").alias("date")).agg(
        *[(F.sum(F.when(F.col("o_orderpriority").startswith(str(i)), F.col("o_totalprice"))) / SCALE).alias(f"p{i}") for i in range(1, 6)]
    )


ORDER_SQL = "wide AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, " + ", ".join(
    f"sum(CASE WHEN o_orderpriority LIKE '{i}%' THEN o_totalprice END) / 999983.0 AS p{i}" for i in range(1, 6)
) + " FROM orders GROUP BY 1)"
P = ["p1", "p2", "p3", "p4", "p5"]


def order_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_panel(spark, sf_dir).unpivot(["date"], P, "series", "value")


ORDER_LONG_SQL = ORDER_SQL + ", olong AS (" + " UNION ALL ".join(f"SELECT date, '{p}' AS series, {p} AS value FROM wide" for p in P) + ")"


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts of the monthly order value of each priority, six models, horizons 1 and 3."""
    long = order_long(spark, sf_dir).select(F.col("series").alias("target"), "date", F.col("value").alias("y"))
    return window_forecasts(long, (1, 3))


def _forecast_sql(h: int) -> str:
    w = "PARTITION BY series ORDER BY date"
    past = f"({w} ROWS BETWEEN UNBOUNDED PRECEDING AND {h} PRECEDING)"
    return f"""SELECT series AS target, {h} AS horizon, lag(date, {h}) OVER ({w}) AS origin,
      CAST(row_number() OVER ({w}) - 1 - {h} AS INTEGER) AS origin_pos, date, value AS actual,
      last_value(value IGNORE NULLS) OVER {past} AS naive, lag(value, 12) OVER ({w}) AS seasonal_naive, avg(value) OVER {past} AS hist_mean,
      last_value(value IGNORE NULLS) OVER {past} + {h} * (last_value(value IGNORE NULLS) OVER {past} - first_value(value IGNORE NULLS) OVER {past})
        / nullif(count(value) OVER {past} - 1, 0) AS drift,
      CASE WHEN count(value) OVER m{h} = 3 THEN avg(value) OVER m{h} END AS ma3,
      CASE WHEN regr_count(value, x{h}) OVER {past} >= 24 THEN regr_intercept(value, x{h}) OVER {past} + regr_slope(value, x{h}) OVER {past} * x{h} END AS ar1
    FROM (SELECT *, lag(value, {h}) OVER ({w}) AS x{h} FROM olong)
    WINDOW m{h} AS ({w} ROWS BETWEEN {h + 2} PRECEDING AND {h} PRECEDING)"""


MODELS = ["naive", "seasonal_naive", "hist_mean", "drift", "ma3", "ar1"]
FORECAST_SQL = (
    ORDER_LONG_SQL + ", f0 AS (" + " UNION ALL ".join(f"SELECT * FROM ({_forecast_sql(h)})" for h in (1, 3)) + "), fc AS ("
    + " UNION ALL ".join(
        f"SELECT target, horizon, origin, origin_pos, date, '{m}' AS model, {m} AS prediction, actual FROM f0 WHERE origin_pos >= 24" for m in MODELS
    )
    + ")"
)
