"""Spark-native analytics over venue order books, event streams and relational tables."""
