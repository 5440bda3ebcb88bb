"""Spark-native engine for multi-sample event tables: gates, populations, statistics."""
