"""Spark-native analytics over crawled websites."""
