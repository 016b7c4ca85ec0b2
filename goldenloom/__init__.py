"""Spark-native master-data analytics: DataFrame in, DataFrame out."""

__version__ = "0.1.0"
