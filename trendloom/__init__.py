"""Spark-native trend detection and issue ranking."""
