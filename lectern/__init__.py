"""Spark-native analytics over reviewed documents."""
