"""Spark-native forecasting analytics over time-series panels."""
