"""Spark-native structured memory analytics."""
