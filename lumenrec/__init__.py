"""Spark-native recommendation analytics."""
