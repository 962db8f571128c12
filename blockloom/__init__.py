"""Spark-native corpus preparation, example assembly and run analytics."""
