"""Spark-native analytics over daily and intraday market-bar panels."""
