"""Spark-native wind resource analytics: declarative operators over DataFrames."""
