"""Streaming forms: windowed panels of events and running forecast scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, max_files: int = 1) -> DataFrame:
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", max_files).parquet(path)


def tumbling_panel(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Sum, mean and count per window and event type; rows later than the watermark are dropped."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = stamped.groupBy(F.window("ts", size), "event_type").agg(F.sum("value").alias("total"), F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
    return g.select(F.col("window.start").alias("start"), "event_type", "total", "mean", "n")


def sliding_panel(events: DataFrame, size: str = "6 hours", slide: str = "1 hour", late: str = "2 hours") -> DataFrame:
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = stamped.groupBy(F.window("ts", size, slide), "event_type").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
    return g.select(F.col("window.start").alias("start"), "event_type", "mean", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = stamped.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n", "total")


def online_scores(forecasts: DataFrame) -> DataFrame:
    """Running accuracy per target, horizon and model over a stream of realised forecasts."""
    e = F.col("actual") - F.col("prediction")
    return forecasts.groupBy("target", "horizon", "model").agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.count(e).alias("n"))


def drain(stream: DataFrame, checkpoint: str, mode: str = "complete", name: str = "drained") -> DataFrame:
    """Run a stream over what is there now and give the result table."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
